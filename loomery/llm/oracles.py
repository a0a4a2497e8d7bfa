"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    """Spans per kind from what lies between matches: the n-th match ends where n pieces and n matches end."""
    # fixed values: the kinds in their order; group of the match whose length counts, and its least length
    kinds = (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", r"AKIA[A-Z0-9]+", 0, 20),
        ("hex", r"[0-9a-f]{24,}", 0, 24),
        ("private_key", r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----)?", 0, 1),
        ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", 0, 1),
        ("provider_token", r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|glpat-[A-Za-z0-9_-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{24,})", 0, 1),
        ("url_password", r"\b[a-zA-Z][a-zA-Z0-9+.-]+://[^\s:/@]+:[^\s:/@]+@", 0, 1),
    )
    each = " UNION ALL ".join(
        f"SELECT r, {k} AS k, {_q(kind)} AS kind, {least} AS least, regexp_extract_all(t, {_q(p)}) AS m, regexp_extract_all(t, {_q(p)}, {group}) AS g, string_split_regex(t, {_q(p)}) AS a FROM d WHERE regexp_matches(t, {_q(p)})"
        for k, (kind, p, group, least) in enumerate(kinds)
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    f AS ({each}),
    n AS (SELECT r, k, kind, least, unnest(range(1, len(m) + 1)) AS i, m, g, a FROM f),
    s AS (SELECT r, k, kind, list_sum(list_transform(list_slice(a, 1, i), lambda x: length(x))) + coalesce(list_sum(list_transform(list_slice(m, 1, i - 1), lambda x: length(x))), 0) AS b, length(m[i]) AS size, length(g[i]) >= least AS ok FROM n),
    o AS (SELECT r, k, b, kind || ':' || CAST(b AS BIGINT) || ':' || CAST(b + size AS BIGINT) AS span FROM s WHERE ok),
    w AS (SELECT r, count(*) FILTER (k = 0) AS n0, count(*) FILTER (k = 1) AS n1, count(*) FILTER (k = 2) AS n2, string_agg(span, ',' ORDER BY b, k) FILTER (k < 3) AS base, string_agg(span, ',' ORDER BY b, k) AS spans FROM o GROUP BY r)
    SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN w USING (r)
    """


def _licences() -> str:
    from . import licences

    def canonical(x: str) -> str:
        lines = r"(?m)^[ \t/*#;-]*(?:copyright\b[^\n]*(?:\d{4}|\(c\)|©)|\(c\)[ \t]|©|all rights reserved)[^\n]*$"
        out = f"' ' || regexp_replace(regexp_replace(lower({x}), {_q(lines)}, '', 'g'), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g') || ' '"
        for one, other in licences.EQUAL_SPELLINGS:
            out = f"replace({out}, {_q(one)}, {_q(other)})"
        return f"trim(regexp_replace({out}, '  +', ' ', 'g'))"

    def rows(pairs) -> str:
        return ", ".join(f"({_q(a)}, {_q(b)})" for a, b in pairs)

    return f"""
    WITH texts(licence, t) AS (VALUES {rows(licences.TEXTS + licences.NOTICES)}),
    more(licence, digest) AS (VALUES {rows(licences.DIGESTS)}),
    known AS (SELECT digest, min(licence) AS licence FROM (SELECT sha256({canonical("t")}) AS digest, licence FROM texts UNION ALL SELECT digest, licence FROM more) GROUP BY digest),
    notes(licence, t) AS (VALUES {rows(licences.NOTICES)}),
    lines AS (SELECT sha256({canonical("t")}) AS digest, min(licence) AS licence FROM notes GROUP BY 1),
    d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    h AS (SELECT r, doc_id, sha256({canonical("t")}) AS text_digest FROM d),
    l AS (SELECT r, unnest(string_split(t, chr(10))) AS x FROM d),
    n AS (SELECT r, string_agg(DISTINCT licence, ',' ORDER BY licence) AS found FROM (SELECT r, sha256({canonical("x")}) AS digest FROM l) JOIN lines USING (digest) GROUP BY r)
    SELECT doc_id, text_digest, licence AS text_licence, coalesce(found, '') AS notice_licences FROM h LEFT JOIN known ON text_digest = digest LEFT JOIN n USING (r)
    """


#: One example ends at every assistant turn, and at the last turn; its text is that of all turns up to there.
_CHAT = r"""
    WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
    p AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY conv_id) AS of,
            length('<|im_start|>') + length(regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<(\\*)\|', '<\\\1|', 'g')) + 1 + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 AS size
        FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    e AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM p)
    SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
        CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(upto) FILTER (role = 'assistant' OR n = of) AS BIGINT) AS formatted_chars
    FROM e GROUP BY conv_id
"""

#: Types by the smallest id of equal payloads; base32 by five hex digits at a time; order and numbers of captures by windows.
_WARC = r"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, coalesce(url, '') AS url, sha1(coalesce(html, '')) AS digest,
            strftime(make_timestamp(CAST((1704067200 + ((coalesce(page_id, 0) % 100000000) + 100000000) % 100000000) * 1000000 AS BIGINT)), '%Y%m%d%H%M%S') AS captured FROM pages),
    k AS (SELECT *, min(page_id) OVER (PARTITION BY digest) AS first, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www[0-9]*\.', '') AS host,
            lower(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', ''), '(?s)#.*$', '')) AS rest FROM p),
    b AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END AS url_key,
            array_to_string(list_transform(range(0, 8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
                substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(digest, CAST(5 * i + 1 AS BIGINT), 5) AS BIGINT) >> s) & 31), 1)), '')), '') AS base32 FROM k)
    SELECT page_id, strlen(html) AS payload_bytes, base32 AS payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
        CASE WHEN first IS NULL OR page_id = first THEN NULL ELSE first END AS refers_to, url_key, captured,
        row_number() OVER (PARTITION BY url_key ORDER BY captured, page_id NULLS FIRST, base32) AS capture_no, row_number() OVER (ORDER BY url_key, captured, page_id NULLS FIRST, base32) - 1 AS cdx_rank
    FROM b
"""

#: All groups' shares of all kept terms of their language, then every pair of groups and every group against its language.
_DIVERGENCE = r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
    k AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
    v AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS n FROM k GROUP BY lang),
    a AS (SELECT lang, source, CAST(coalesce(sum(c.n), 0) AS HUGEINT) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
    p AS (SELECT a.lang, a.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (a.n + 2 * v.v) AS p, 1 + 1000000000 * (k.n + 2) // (v.n + 2 * v.v) AS q
        FROM a JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = a.lang AND c.source = a.source AND c.term = k.term),
    s AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
    e AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
        UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p WHERE n > 0 AND p > q),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM e)
    SELECT * FROM o WHERE part = 'pair' OR rank <= 10
"""

ORACLES: dict[str, str] = {"op4_blob_ledger": _secrets(), "op8_licence_digests": _licences(), "op10_prefix_targets": _CHAT, "op11_loser_tree": _WARC, "op12_divergence_tiles": _DIVERGENCE}
