"""Messages of the property graph: JSON objects of nodes to cells and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what one message may hold
MOST_NODES, MOST_KEYS, MOST_BYTES = 1000, 10_000, 10 * 1024 * 1024


def decode(messages: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, soul, key, vtype, v_text, v_num, v_bool, v_link, state) of all cells of {soul: {"_": {"#": soul, ">": {key: state}}, key: value}}.

    Left out: messages that are too large or not JSON, nodes beyond the first MOST_NODES by soul, nodes whose own soul
    isn't their name, nodes with too many keys, values that are arrays or objects other than a link.  A value without a
    state has the least one.
    """
    sized = messages.filter(F.octet_length(json_col) <= MOST_BYTES).select(F.col(id_col).alias("id"), F.try_parse_json(json_col).alias("v")).filter("v IS NOT NULL")
    spark = messages.sparkSession
    cells = spark.sql(
        """WITH nodes AS (
          SELECT m.id, n.key AS soul, n.value AS node, try_variant_get(n.value, "$['_']['>']", 'map<string,variant>') AS states
          FROM {sized} m, LATERAL variant_explode(m.v) n
          WHERE n.pos < {nodes} AND try_variant_get(n.value, "$['_']['#']", 'string') = n.key AND try_variant_get(n.value, "$['_']['>']", 'map<string,variant>') IS NOT NULL)
        SELECT id, soul, c.key, c.value, schema_of_variant(c.value) AS kind, states, count(*) OVER (PARTITION BY id, soul) AS keys
        FROM nodes, LATERAL variant_explode(node) c WHERE c.key <> '_'""",
        sized=sized,
        nodes=MOST_NODES,
    ).filter(F.col("keys") <= MOST_KEYS)
    kind = F.col("kind")
    number = kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    vtype = F.when(kind == "VOID", "null").when(kind == "STRING", "text").when(kind == "BOOLEAN", "bool").when(number, "num").when(kind == "OBJECT<`#`: STRING>", "link")
    state = F.try_variant_get(F.try_element_at("states", F.col("key")), "$", "double")
    return (
        cells.withColumn("vtype", vtype)
        .filter("vtype IS NOT NULL")
        .select(
            "id",
            "soul",
            "key",
            "vtype",
            F.when(F.col("vtype") == "text", F.try_variant_get("value", "$", "string")).alias("v_text"),
            F.when(F.col("vtype") == "num", F.try_variant_get("value", "$", "double")).alias("v_num"),
            F.when(F.col("vtype") == "bool", F.try_variant_get("value", "$", "boolean")).alias("v_bool"),
            F.when(F.col("vtype") == "link", F.try_variant_get("value", "$['#']", "string")).alias("v_link"),
            F.coalesce(state, F.lit(float("-inf"))).alias("state"),
        )
    )


def quoted(text: Column) -> Column:
    """``text`` as a JSON string."""
    return F.substring(F.to_json(F.struct(text.alias("t"))), F.lit(6), F.length(F.to_json(F.struct(text.alias("t")))) - 6)


def value_json(vtype: Column, v_text: Column, v_num: Column, v_bool: Column, v_link: Column) -> Column:
    link = F.concat(F.lit('{"#":'), quoted(v_link), F.lit("}"))
    return F.when(vtype == "text", quoted(v_text)).when(vtype == "num", v_num.cast("string")).when(vtype == "bool", v_bool.cast("string")).when(vtype == "link", link).otherwise("null")


def encode(cells: DataFrame) -> DataFrame:
    """(soul, json): one message for each soul with all its cells, keys in order."""
    value = value_json(*(F.col(c) for c in ("vtype", "v_text", "v_num", "v_bool", "v_link")))
    # a soul's cells are one node of one message in the end
    rows = cells.groupBy("soul").agg(F.array_sort(F.collect_list(F.struct(quoted(F.col("key")).alias("k"), value.alias("v"), F.col("state").cast("string").alias("s")))).alias("rows"))
    soul = quoted(F.col("soul"))

    def joined(c: str) -> Column:
        return F.array_join(F.transform("rows", lambda x: F.concat(x["k"], F.lit(":"), x[c])), ",")

    return rows.select("soul", F.concat(F.lit("{"), soul, F.lit(':{"_":{"#":'), soul, F.lit(',">":{'), joined("s"), F.lit("}},"), joined("v"), F.lit("}}")).alias("json"))
