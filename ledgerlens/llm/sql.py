"""DuckDB SQL of the queries that SQL can express, over the whole test tables."""

from __future__ import annotations

from . import jump_shards, mixing, multiset_hash

WORDS = "coalesce(len(regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+')), 0)"


def _jump(key: str, shards: int) -> str:
    """A list fold over the generator's steps; state, shard and next step as one struct."""
    step = f"(acc.state * {jump_shards.MULTIPLIER}::HUGEINT + 1) % {jump_shards.TWO_64}::HUGEINT"
    jump = (
        f"floor((acc.next + 1)::DOUBLE * ({jump_shards.TWO_31}::DOUBLE / "
        f"(({step}) // {jump_shards.TWO_33}::HUGEINT + 1)::DOUBLE))::BIGINT"
    )
    start = (
        f"{{'state': ((coalesce({key}, 0)::HUGEINT + {jump_shards.TWO_64}::HUGEINT) % {jump_shards.TWO_64}::HUGEINT),"
        " 'shard': (-1)::BIGINT, 'next': 0::BIGINT}"
    )
    fold = (
        f"CASE WHEN acc.next >= {shards} THEN acc ELSE "
        f"{{'state': {step}, 'shard': acc.next, 'next': {jump}}} END"
    )
    dummies = f"list_transform(range({shards}), lambda i: {{'state': 0::HUGEINT, 'shard': 0::BIGINT, 'next': 0::BIGINT}})"
    return f"list_reduce(list_prepend({start}, {dummies}), lambda acc, x: {fold}).shard::INTEGER"


def _crc32(text: str) -> tuple[str, str]:
    """CRC-32 of a text's UTF-8 bytes: a list fold with the table of one byte's remainders."""
    table = (
        "list_transform(range(256), lambda n: list_reduce(list_prepend(n::BIGINT, range(8)), "
        "lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END))"
    )
    codes = f"list_transform(regexp_extract_all(hex(encode(coalesce({text}, ''))), '..'), lambda h: ('0x' || h)::BIGINT)"
    fold = (
        f"list_reduce(list_prepend(4294967295::BIGINT, {codes}), "
        "lambda c, x: xor(list_extract(remainders, xor(c & 255, x) + 1), c >> 8))"
    )
    return f"xor({fold}, 4294967295::BIGINT)", table


def op4(shards: int) -> str:
    crc, table = _crc32("text")
    return f"""
WITH crc AS (SELECT {table} AS remainders),
rows AS (
  SELECT doc_id, (coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS size, {crc} AS text_crc32,
         {_jump('doc_id', shards)} AS shard, {_jump('doc_id', shards + 1)} AS grown_shard,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS place
  FROM documents, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id, text_crc32, size) - 1 AS slot, grown_shard
FROM rows"""


def op5() -> str:
    return """
WITH rows AS (
  SELECT doc_id, coalesce(length(text), 0) AS chars,
         regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS content
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY content ORDER BY chars DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = first_value(doc_id) OVER (PARTITION BY content ORDER BY chars DESC, doc_id) AS kept,
       sha256(content) AS text_sha256
FROM rows"""


def op7() -> str:
    m = multiset_hash
    low = m.LOW

    def pieces(text: str) -> str:
        return f"regexp_extract_all({text}, '{m.PIECES}')"

    def sums(text: str) -> str:
        """Lane sums of a text's pieces, unpacked: 120 numbers in the packed longs' order."""
        halves = []
        for i in range(m.HASH_LONGS):
            longs = f"list_transform({pieces(text)}, lambda p: ('0x' || substr(sha256(p), {1 + 15 * i}, 15))::BIGINT)"
            halves.append(
                f"list_transform(range({m.LANE_BITS}), lambda s: coalesce(list_sum(list_transform({longs}, "
                f"lambda h: (h >> s::BIGINT) & {low}::BIGINT)), 0)::BIGINT)"
            )
        return f"list_concat({', '.join(halves)})"

    def centred(v: str, n: str) -> str:
        return (
            f"flatten(list_transform({v}, lambda x: list_transform(range({m.LANES_A_LONG}), "
            f"lambda i: 2 * ((x >> ({m.LANE_BITS} * i)::BIGINT) & {m.LANE_MODULUS - 1}::BIGINT) - {n})))"
        )

    def text_form(v: str, n: str) -> str:
        return f"printf('%x', {n}) || ':' || array_to_string(list_transform({v}, lambda x: printf('%015x', x)), '')"

    def dot(a: str, b: str) -> str:
        return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"

    def near(a: str, b: str, same: str) -> str:
        return (
            f"CASE WHEN {same} THEN 1.0::DOUBLE WHEN {dot(a, a)} = 0 OR {dot(b, b)} = 0 THEN 0.0::DOUBLE "
            f"ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, {dot(a, b)}::DOUBLE / "
            f"(sqrt({dot(a, a)}::DOUBLE) * sqrt({dot(b, b)}::DOUBLE)))) END"
        )

    return f"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n_chars,
         coalesce(lead(coalesce(text, '')) OVER (ORDER BY doc_id DESC),
                  first_value(coalesce(text, '')) OVER (ORDER BY doc_id DESC)) AS next
  FROM documents),
edited AS (
  SELECT *, substr(text, 1, n_chars - n_chars // 3) || substr(next, 1, n_chars // 3) AS edited FROM texts),
summed AS (
  SELECT *, {sums('text')} AS v0, len({pieces('text')})::BIGINT AS n0,
         {sums('edited')} AS v1, len({pieces('edited')})::BIGINT AS n1,
         {sums('next')} AS v2, len({pieces('next')})::BIGINT AS n2 FROM edited),
printed AS (
  SELECT *, {text_form('v0', 'n0')} AS f0, {text_form('v1', 'n1')} AS f1, {text_form('v2', 'n2')} AS f2,
         {centred('v0', 'n0')} AS c0, {centred('v1', 'n1')} AS c1, {centred('v2', 'n2')} AS c2 FROM summed)
SELECT doc_id, n_chars, sha256(edited) AS edited_sha256, f0 AS fingerprint, f1 AS edited_fingerprint,
       {near('c0', 'c1', 'f0 = f1')} AS near_edited, {near('c0', 'c2', 'f0 = f2')} AS near_next
FROM printed"""


def op10(weights: tuple[float, ...], max_epochs: int) -> str:
    listed = ", ".join(f"{w}::DOUBLE" for w in weights)
    low = mixing.WEIGHT_STEPS[0]
    return f"""
WITH rows AS (
  SELECT doc_id, source, {WORDS.format('text')}::BIGINT AS size,
         -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / {2.0**52}::DOUBLE)
         / greatest({low}::DOUBLE, coalesce((length(text) - length(regexp_replace(text, '[a-z ]+', '', 'g')))::DOUBLE
                    / greatest(length(text), 1)::DOUBLE, 0.0)) AS key
  FROM documents),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, list_extract([{listed}], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(weights)}) + 1) AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes),
filled AS (SELECT *, source_size * {max_epochs} AS cap, (source_size * {max_epochs})::DOUBLE / weight AS fill FROM weighed),
shares AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS share
  FROM filled WINDOW before AS (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * greatest(0.0, max(share) OVER ())) AS target FROM shares),
summed AS (
  SELECT r.doc_id, r.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS epochs,
         coalesce(sum(r.size) OVER (PARTITION BY r.source ORDER BY r.key, r.doc_id, r.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, r.source
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - before)))::BIGINT AS taken,
       source
FROM summed"""


def op11(k: int, scale: int, every: int) -> str:
    whole = f"list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT)"
    return f"""
WITH whole AS (
  SELECT vec_id, {whole} AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, w.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.v, w.v), lambda z: z[1] * z[2])), 0)::BIGINT AS score
  FROM whole q JOIN whole w ON q.vec_id <> w.vec_id
  WHERE q.vec_id % {every} = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
  FROM scored)
SELECT * FROM ranked WHERE rank <= {k}"""


def op12(k: int) -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

    def terms(text: str) -> str:
        return f"regexp_extract_all(translate({text}, {letters}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

    return f"""
WITH texts AS (SELECT doc_id, {terms('text')} AS terms FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT doc_id, len(terms)::BIGINT AS n, terms FROM texts WHERE len(terms) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS words FROM sizes),
counted AS (
  SELECT doc_id, n, term, count(*)::BIGINT AS tf
  FROM (SELECT doc_id, n, unnest(terms) AS term FROM sizes) GROUP BY doc_id, n, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counted, totals GROUP BY term, docs),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS times
  FROM (SELECT item_id, unnest({terms('text')}) AS term FROM benchmark) GROUP BY item_id, term),
scored AS (
  SELECT item_id, doc_id,
         sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN counted USING (term), totals
  GROUP BY item_id, doc_id),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
  FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= {k}"""


def op13(fan_out: int) -> str:
    crc, table = _crc32("doc_id::VARCHAR")

    def field(value: str) -> str:
        return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'lang', 'n_chars', text)))})"

    step = (
        f"list_transform(range(0, len(nodes), {fan_out}), "
        f"lambda i: sha256(array_to_string(list_slice(nodes, i + 1, i + {fan_out}), '')))"
    )

    def beside(place: str) -> str:
        begin = f"({place} - {place} % {fan_out})"
        return (
            f"{{'before': array_to_string(list_slice(nodes, {begin} + 1, {place}), ''), "
            f"'after': array_to_string(list_slice(nodes, {place} + 2, {begin} + {fan_out}), '')}}"
        )

    place = f"(pos // pow({fan_out}, level)::BIGINT)"
    return f"""
WITH RECURSIVE crc AS (SELECT {table} AS remainders),
rows AS (
  SELECT doc_id, source, {leaf('text')} AS leaf,
         CASE WHEN ({crc}) % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} ELSE {leaf('text')} END AS shown
  FROM documents, crc),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id, leaf) - 1 AS pos FROM rows),
levels AS (
  SELECT source, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY source
  UNION ALL
  SELECT source, level + 1, {step} FROM levels WHERE len(nodes) > 1),
subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos
  FROM levels WHERE len(nodes) = 1),
upper AS (
  SELECT 0 AS level, list(subroot ORDER BY pos) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, {step} FROM upper WHERE len(nodes) > 1),
lower_paths AS (
  SELECT p.doc_id, p.source, p.pos, list({beside(place)} ORDER BY level) FILTER (len(nodes) > 1) AS path
  FROM placed p JOIN levels l ON p.source IS NOT DISTINCT FROM l.source GROUP BY p.doc_id, p.source, p.pos),
upper_paths AS (
  SELECT source, subroot, list({beside(place)} ORDER BY level) FILTER (len(nodes) > 1) AS path
  FROM subroots, upper GROUP BY source, subroot),
proofs AS (
  SELECT p.doc_id, p.leaf, p.shown, u.subroot, (SELECT nodes[1] FROM upper WHERE len(nodes) = 1) AS root,
         list_concat(coalesce(l.path, []), coalesce(u.path, [])) AS path
  FROM placed p
  JOIN lower_paths l ON p.source IS NOT DISTINCT FROM l.source AND p.pos = l.pos
  JOIN upper_paths u ON p.source IS NOT DISTINCT FROM u.source),
folded AS (
  SELECT *, list_reduce(list_prepend({{'before': shown, 'after': ''}}, path),
                        lambda node, s: {{'before': sha256(s.before || node.before || s.after), 'after': ''}}).before AS folded_root
  FROM proofs)
SELECT doc_id, leaf, subroot, root,
       sha256(array_to_string(list_transform(path, lambda s: s.before || s.after), '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM folded"""
