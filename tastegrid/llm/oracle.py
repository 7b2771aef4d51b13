"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

from . import conversation_trie, licenses, mixing, quality_rules

WORD = r"'[^\x20\x09-\x0D]+'"
SPACE = r"'[\x20\x09-\x0D]+'"


def _hash48(key: str, name: str) -> str:
    return f"('0x' || md5({key} || ':' || {name})[1:12])::BIGINT"


def _crc_table() -> list[int]:
    """CRC-32 of each byte, by the reflected polynomial."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


def _placed(n: int) -> str:
    """rid -> shard in a tree of n shards, three draws one after the other."""
    draw = lambda name: f"-ln(({_hash48('k', name)} + 1) / 281474976710657.0::DOUBLE) / w"
    return f"""
  leaf{n} AS (SELECT 'g' || s // 8 AS region, 'g' || s // 8 || '/k' || s // 4 % 2 AS rack, s FROM range({n}) t(s)),
  region{n} AS (SELECT rid, k, arg_min(region, {draw('region')}) AS region FROM d, (SELECT region, count(*)::DOUBLE AS w FROM leaf{n} GROUP BY 1) GROUP BY 1, 2),
  rack{n} AS (SELECT rid, k, arg_min(rack, {draw('rack')}) AS rack FROM region{n} JOIN (SELECT region, rack, count(*)::DOUBLE AS w FROM leaf{n} GROUP BY 1, 2) USING (region) GROUP BY 1, 2),
  shard{n} AS (SELECT rid, arg_min(s, {draw("'s' || s")})::INT AS shard FROM rack{n} JOIN (SELECT rack, s, 1.0::DOUBLE AS w FROM leaf{n}) USING (rack) GROUP BY 1)"""


SHARDING = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(doc_id::VARCHAR, '') AS k, coalesce(text, '') AS t FROM documents), {_placed(24)}, {_placed(25)},
  sized AS (SELECT d.*, a.shard, b.shard AS grown_shard, octet_length(encode(t)) + 8 AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::BIGINT), lambda a, b: xor(a >> 8, list_extract(CAST({_crc_table()} AS BIGINT[]), (xor(a, b) & 255) + 1)), 4294967295::BIGINT), 4294967295) AS text_crc32
    FROM d JOIN shard24 a USING (rid) JOIN shard25 b USING (rid))
  SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY {_hash48('k', "'slot'")} * 256 // 281474976710656, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, grown_shard FROM sized"""

_W = list(mixing.WEIGHTS)
_LEVELS = mixing.N_SHARDS.bit_length() - 1


def _room(shard: str) -> str:
    """The blocks that the shards before have, of n in all."""
    return f"({shard} * (n // {mixing.N_SHARDS}) + least({shard}, n % {mixing.N_SHARDS}))"


def _split(level: int) -> str:
    """The nodes of one level of the tree of blocks, from those of the level above; N_SHARDS is a power of 2."""
    width = mixing.N_SHARDS >> level
    key = f"lo || '-' || (lo + {width}) || ':' || s"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY lo ORDER BY {_hash48(key, 'b')}, s, b) AS k FROM node{level}"
    return f"node{level + 1} AS (SELECT s, b, lo + CASE WHEN k <= {_room(f'(lo + {width // 2})')} - {_room('lo')} THEN 0 ELSE {width // 2} END AS lo FROM ({ranked}), total)"


_TREE = ", ".join(map(_split, range(_LEVELS)))
MIXING = f"""WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {WORD})), 0) AS size, {_hash48("coalesce(doc_id::VARCHAR, '')", "'mix'")} AS h FROM documents),
  s AS (SELECT source, sum(size) AS source_size, list_extract(CAST({_W} AS DOUBLE[]), ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(_W)})::INT + 1) AS weight, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
  c AS (SELECT *, source_size * {mixing.MAX_REPEATS} AS cap, source_size * {mixing.MAX_REPEATS} / weight AS ratio, sum(source_size) OVER () AS total FROM s),
  l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY ratio, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY ratio, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
  t AS (SELECT source, source_size::BIGINT AS source_size, coalesce(least(cap::DOUBLE, (SELECT arg_min(level, (ratio, r)) FROM l WHERE level <= ratio) * weight), 0.0) AS target FROM l),
  p AS (SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS take, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
  q AS (SELECT *, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS passes FROM p),
  x AS (SELECT *, greatest(0, least(take - passes * source_size - before, size)) AS extra FROM q),
  n AS (SELECT greatest({mixing.BLOCK_WORDS}, coalesce(sum(floor(target + 0.5)), 0)::BIGINT // {mixing.MAX_BLOCKS} + 1) AS length FROM t),
  b AS (SELECT r - 1 AS s, unnest(range((floor(target + 0.5)::BIGINT + length - 1) // length)) AS b FROM t JOIN s ON t.source IS NOT DISTINCT FROM s.source, n),
  total AS (SELECT count(*) AS n FROM b), node0 AS (SELECT s, b, 0 AS lo FROM b), {_TREE},
  firsts AS (SELECT s, list(f ORDER BY shard) AS firsts FROM (SELECT s.r - 1 AS s, shard, (SELECT count(*) FROM node{_LEVELS} m WHERE m.s = s.r - 1 AND m.lo < shard) AS f FROM s, range({mixing.N_SHARDS}) g(shard)) GROUP BY 1),
  y AS (SELECT x.*, list_transform(list_filter(range({mixing.MAX_REPEATS + 1}), lambda c: size > 0 AND (c < passes OR c = passes AND extra > 0)), lambda c: (c * x.source_size + before)::BIGINT // length) AS blocks, firsts
    FROM x JOIN s ON x.source IS NOT DISTINCT FROM s.source JOIN firsts ON firsts.s = s.r - 1, n)
  SELECT doc_id, size::BIGINT AS size, source_size, target, (passes * size + extra)::BIGINT AS taken, len(blocks)::BIGINT AS n_copies, array_to_string(blocks, ',') AS blocks,
    array_to_string(list_transform(blocks, lambda k: len(list_filter(firsts, lambda f: f <= k)) - 1), ',') AS shards FROM y"""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
JACCARD = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {WORD}) AS w FROM documents),
  sets AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+3], ' ') END AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
  n AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
  both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sets a JOIN sets b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
  links AS (SELECT a, b FROM both_in JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 85 * (x.n + y.n - k)),
  edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
  reach AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id)"""

QUALITY = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {WORD}) AS w FROM documents),
  g AS (SELECT rid, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
  again AS (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS last FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
  rep AS (SELECT rid, sum(least(5, i - coalesce(last, i - 5)))::BIGINT AS n_repeat_words FROM again GROUP BY 1),
  ln AS (SELECT rid, doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
  dup AS (SELECT rid, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
  clean AS (SELECT rid, doc_id, source, t, trim(regexp_replace(lower(line), {SPACE}, ' ', 'g')) AS line FROM ln WHERE trim(regexp_replace(line, {SPACE}, ' ', 'g')) <> ''),
  hosts AS (SELECT source, count(DISTINCT t) AS of_host FROM d GROUP BY 1),
  often AS (SELECT c.source, line, min(doc_id) AS first FROM clean c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source GROUP BY c.source, line, of_host HAVING count(DISTINCT t) > greatest({quality_rules.MIN_LINE_DOCUMENTS}, least({quality_rules.MOST_LINE_DOCUMENTS}, of_host * {quality_rules.LINE_DOCUMENT_SHARE}))),
  gone AS (SELECT rid, sum(len(string_split(c.line, ' ')))::BIGINT AS n FROM clean c JOIN often o ON c.source IS NOT DISTINCT FROM o.source AND c.line = o.line AND c.doc_id IS DISTINCT FROM o.first GROUP BY 1),
  x AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, {SPACE}, '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n, 0) AS n_removed_words FROM d LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)),
  y AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM x)
  SELECT *, NOT base_failed AND NOT (n_words - n_removed_words < n_words * {quality_rules.MIN_LEFT}) AS kept FROM y"""

WARC = """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM p)
  SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, (i // 4 * 5 + 1)::INT, 5))::BIGINT) >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), '') AS payload_digest,
    CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first < page_id THEN first END AS refers_to FROM f"""

HAMMING = """WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS c FROM embeddings),
  d AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, list_sum(list_transform(list_zip(q.c, b.c), lambda z: xor(z[1], z[2])))::INT AS distance FROM b q, b WHERE q.vec_id % 20 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d) SELECT query_id, rank, neighbour_id, distance FROM r WHERE rank <= 10"""

_GRAMS = [licenses.bigrams(licenses.normal(t)) for _, t in licenses.TEMPLATES]
_ANCHORS = licenses.anchors()
LICENSES = f"""WITH t AS (SELECT unnest({[n for n, _ in licenses.TEMPLATES]}) AS license, unnest(range({len(_GRAMS)})) AS template, unnest({_GRAMS}) AS grams),
  k AS (SELECT unnest(range({len(_GRAMS)})) AS template, unnest({[len(licenses.normal(x)) for _, x in licenses.TEMPLATES]}) AS words),
  u AS (SELECT rid, doc_id, unnest(list_distinct(list_concat(list_concat(string_split(x, chr(10)), regexp_split_to_array(x, '\\n\\s*\\n')), [x]))) AS u FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x FROM documents)),
  w AS (SELECT rid, doc_id, list_filter(string_split(regexp_replace(lower(u), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM u WHERE regexp_matches(lower(u), '{"|".join(licenses.key_words())}')),
  g AS (SELECT DISTINCT rid, doc_id, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i+1]))) AS g FROM w WHERE len(w) > 1),
  m AS (SELECT rid, g, license, template, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM g, t),
  best AS (SELECT rid, g, arg_min((license, template, dice), (-dice, license, template)) AS b FROM m WHERE dice >= {licenses.MIN_DICE} GROUP BY 1, 2),
  a AS (SELECT unnest({[w for w, _, _ in _ANCHORS]}) AS word, unnest({[t for _, t, _ in _ANCHORS]}) AS template, unnest({[p for _, _, p in _ANCHORS]}) AS place),
  e AS (SELECT rid, list_filter(string_split(regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM (SELECT row_number() OVER () AS rid, coalesce(text, '') AS x FROM documents)),
  h AS (SELECT DISTINCT p.rid, p.w, template, i - 1 - place AS start FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM e) p JOIN a ON p.w[p.i] = a.word),
  v AS (SELECT rid, h.template, license, start, start + words AS stop, grams, list_distinct(list_transform(range(greatest(start, 0) + 1, least(start + words, len(w)::BIGINT)), lambda i: w[i] || ' ' || w[i+1])) AS g FROM h JOIN t USING (template) JOIN k USING (template)),
  z AS (SELECT rid, template, license, start, stop, 2.0::DOUBLE * len(list_intersect(g, grams)) / (len(g) + len(grams)) AS dice FROM v),
  zz AS (SELECT * FROM z WHERE dice >= {licenses.MIN_DICE}),
  best2 AS (SELECT rid, b FROM best UNION ALL SELECT rid, (license, template, dice) FROM zz x WHERE NOT EXISTS (SELECT 1 FROM zz y WHERE y.rid = x.rid AND (-y.dice, y.license, y.template, y.start) < (-x.dice, x.license, x.template, x.start) AND y.start < x.stop AND x.start < y.stop)),
  docs AS (SELECT rid, count(DISTINCT b) AS n_matches, array_to_string(list_sort(list_distinct(list(b[1]))), ',') AS licenses, arg_min(b, (-b[3], b[1], b[2])) AS top FROM best2 GROUP BY 1)
  SELECT doc_id, coalesce(n_matches, 0)::BIGINT AS n_matches, coalesce(licenses, '') AS licenses, top[1] AS best_license, coalesce(top[3], 0.0)::DOUBLE AS best_dice FROM (SELECT row_number() OVER () AS rid, doc_id FROM documents) LEFT JOIN docs USING (rid)"""

def _crc32(text: str) -> str:
    """CRC-32 of a text of ASCII characters."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({text}, '.'), lambda x: ascii(x)::BIGINT)), lambda a, b: xor(a >> 8, list_extract(CAST({_crc_table()} AS BIGINT[]), (xor(a, b) & 255) + 1))), 4294967295)"


TRIE = f"""WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS m FROM conversations WHERE conv_id IS NOT NULL),
  c AS (SELECT conv_id, list(m ORDER BY i) AS own FROM t GROUP BY 1), h AS (SELECT *, {_crc32("conv_id::VARCHAR")} % {conversation_trie.OPENINGS} AS h FROM c),
  b AS (SELECT h.conv_id, list_concat(coalesce(base.own[1:h], []), h.own[h + 1:]) AS m FROM h LEFT JOIN c base ON base.conv_id = h.conv_id - h.conv_id % {conversation_trie.FAMILY}),
  p AS (SELECT conv_id, d AS depth, m[1:d] AS k, d = len(m) AS at_end FROM (SELECT conv_id, m, unnest(range(len(m) + 1)) AS d FROM b)),
  n AS (SELECT k, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256, (count(*) - 1) * coalesce(length(k[depth].text), 0) AS saved FROM p GROUP BY k, depth),
  kids AS (SELECT k[1:depth - 1] AS k, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
  f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (k)),
  s AS (SELECT k[1:d] AS k, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved_tokens FROM (SELECT k, n_children, saved, unnest(range(depth + 1)) AS d FROM f) GROUP BY 1)
  SELECT f.conv_id, f.depth, up.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256 FROM f JOIN s USING (k) LEFT JOIN n up ON up.k = f.k[1:f.depth - 1] AND f.depth > 0"""

_DISTANCE = "list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def _clusters(rounds: int) -> str:
    """a{r} and c{r}: nearest centroids and centroids after r rounds."""
    found = lambda r: f"a{r} AS MATERIALIZED (SELECT rid, vec_id, v, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT rid, vec_id, v, k, {_DISTANCE} AS d FROM x, c{r}) GROUP BY 1, 2, 3)"
    floor = "(s - ((s % n) + n) % n) // n"
    mean = lambda r: f"""m{r} AS (SELECT k, list({floor} ORDER BY i) AS c FROM (SELECT k, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM (SELECT k, v, unnest(range(1, 65)) AS i FROM a{r - 1}) GROUP BY 1, 2) GROUP BY 1),
  c{r} AS MATERIALIZED (SELECT k, coalesce(m{r}.c, c{r - 1}.c) AS c FROM c{r - 1} LEFT JOIN m{r} USING (k))"""  # noqa: E731
    return ",\n  ".join([found(0), *(f"{mean(r)}, {found(r)}" for r in range(1, rounds + 1))])


CLUSTERS = f"""WITH x AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, embedding, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)::BIGINT) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
  c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || coalesce(vec_id::VARCHAR, '')), embedding) - 1 AS k, v AS c FROM x QUALIFY k < 40),
  {_clusters(5)}
  SELECT vec_id, k::INT AS cluster, d::BIGINT AS distance, sum(d) OVER (PARTITION BY k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256 FROM a5 JOIN c5 USING (k)"""

SQL: dict[str, str] = {
    "op1_sharding": SHARDING,
    "op2_mixing": MIXING,
    "op3_jaccard_join": JACCARD,
    "op4_quality_rules": QUALITY,
    "op6_warc": WARC,
    "op7_hamming_search": HAMMING,
    "op9_license_scans": LICENSES,
    "op11_conversation_trie": TRIE,
    "op12_centroid_clusters": CLUSTERS,
}
