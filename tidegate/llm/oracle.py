"""DuckDB SQL that gives the rows of the Merkle manifest and of importance resampling, from the given tables alone."""

from __future__ import annotations


def _nibbles() -> list[int]:
    """CRC-32's remainders of four bits, from its polynomial."""
    out = []
    for v in range(16):
        for _ in range(4):
            v = v >> 1 ^ (0xEDB88320 if v & 1 else 0)
        out.append(v)
    return out


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes."""
    table, digits, hx = str(_nibbles()), "'0123456789ABCDEF'", f"hex({text})"
    byte = f"instr({digits}, substr({hx}, 2 * i - 1, 1)) * 16 + instr({digits}, substr({hx}, 2 * i, 1)) - 17"
    step = lambda x: f"xor(({x}) >> 4, {table}[(({x}) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length({hx}) // 2 + 1), lambda i: ({byte})::BIGINT)), lambda c, b: {step(step('xor(c, b)'))}), 4294967295)"


def _field(c: str) -> str:
    return f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"


def merkle(depth: int = 8, fanout: int = 16) -> str:
    """Unrolled to ``depth`` levels, for up to fanout ** depth rows of a source and as many sources."""
    leaf = lambda text: f"sha256({' || '.join(map(_field, ('doc_id', 'source', 'lang', 'n_chars')))} || {_field(text)})"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    ctes = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '') AS tree, {leaf('text')} AS leaf, CASE WHEN {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(low)} END AS claim FROM documents)",
        f"a0 AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS h FROM d)",
    ]
    # a tree's nodes by level; one that stands alone goes up as it is
    grown = lambda a, b, key: f"{b} AS (SELECT {key}, pos // {fanout} AS pos, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h, list(h ORDER BY pos) AS run, max(n) AS n FROM (SELECT {key}, pos, h, count(*) OVER (PARTITION BY {key}) AS n FROM {a}) GROUP BY {key}, pos // {fanout})"
    for k in range(depth):
        ctes.append(grown(f"a{k}", f"a{k + 1}", "tree"))
    ctes.append(f"b0 AS (SELECT 0 AS one, tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM a{depth})")
    for k in range(depth):
        ctes.append(grown(f"b{k}", f"b{k + 1}", "one"))
    joins, rest, folded = [], [], "coalesce(claim, leaf)"
    for level, key in [(f"a{k}", k) for k in range(1, depth + 1)] + [(f"b{k}", k) for k in range(1, depth + 1)]:
        at, on = ("l.pos", f"{level}.tree = l.tree") if level[0] == "a" else ("s.pos", "true")
        joins.append(f"JOIN {level} ON {on} AND {level}.pos = {at} // {fanout ** key}")
        slot = f"{at} // {fanout ** (key - 1)} % {fanout}"
        left, right = f"array_to_string({level}.run[:{slot}], '')", f"array_to_string({level}.run[{slot} + 2:], '')"
        rest.append((level, left, right))
    # folded level by level, since a hash of a hash of a hash doesn't fit one expression
    ctes.append(f"p0 AS (SELECT doc_id, leaf, s.h AS subroot, {folded} AS f, '' AS proof, {', '.join(f'{lv}.n AS n_{lv}, {a} AS l_{lv}, {b} AS r_{lv}' for lv, a, b in rest)} FROM a0 l JOIN b0 s ON s.tree = l.tree {' '.join(joins)})")
    for k, (lv, _, _) in enumerate(rest):
        alone = f"n_{lv} = 1"
        ctes.append(f"p{k + 1} AS (SELECT * REPLACE (CASE WHEN {alone} THEN f ELSE sha256(l_{lv} || f || r_{lv}) END AS f, CASE WHEN {alone} THEN proof ELSE proof || l_{lv} || r_{lv} END AS proof) FROM p{k})")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, b{depth}.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = b{depth}.h AS verified FROM p{len(rest)}, b{depth}"


WORDS = r"coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), [])"


def resampling(percent: int = 25, least: int = 20, seed: int = 7, buckets: int = 10_000) -> str:
    grams = lambda key, frm: f"SELECT {key}, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM {frm}"
    share = lambda a: f"SELECT bucket, count(*) AS n FROM {a} JOIN c USING (g) GROUP BY bucket"
    u = f"((CAST('0x' || substr(sha256('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296)"
    return f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), b AS (SELECT item_id, {WORDS} AS w FROM benchmark),
x AS ({grams('doc_id', 'd')}), y AS ({grams('item_id', 'b')}), c AS (SELECT g, {crc32('g')} % {buckets} AS bucket FROM (SELECT g FROM x UNION SELECT g FROM y)),
s AS ({share('x')}), t AS ({share('y')}),
k AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM x) + {buckets}) / ((s.n + 1)::DOUBLE * ((SELECT count(*) FROM y) + {buckets})))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
v AS (SELECT doc_id, count(*) AS m, sum(gain) AS total FROM x JOIN c USING (g) JOIN k USING (bucket) GROUP BY doc_id),
z AS (SELECT doc_id, coalesce(m, 0) AS n_features, CAST(coalesce(floor(total::DOUBLE / m), 0) AS BIGINT) AS weight, len(w) >= {least} AS fit FROM d LEFT JOIN v USING (doc_id)),
r AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln({u}))) AS BIGINT) AS score FROM z),
o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM r WHERE fit)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= n * {percent} // 100 THEN rank END AS rank FROM r LEFT JOIN o USING (doc_id)"""
