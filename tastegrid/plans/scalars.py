"""Scalar, text, colour, array and grid functions over rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays, color, language, raster, text
from ..functions.jsmath import clamp, logistic, round_half_up
from ..operators import feedback
from ..registry import query
from .base import r6, spread, table


def r4(x):
    return F.floor(x * 1e4 + 0.501) / 1e4


@query("template_render", "SELECT p_partkey, 'cam-' || coalesce(nullif(regexp_replace(p_brand, '#', '-'), ''), 'nocamera') || '_' || lpad(p_size::VARCHAR, 4, '0') || '.dng' AS name FROM part")
def template_render(spark, sf_dir):
    values = {"camera": F.replace("p_brand", F.lit("#"), F.lit("-")), "seq": F.col("p_size"), "ext": F.lit("dng")}
    return table(spark, sf_dir, "part").select("p_partkey", text.rendered("cam-{camera}_{seq:4}.{ext}", values, {"camera": "nocamera"}).alias("name"))


#: Templates for the query below, in turn.
TEMPLATES = ("{date}_{seq:4}.{ext}", "{orig}", "", "{camera}-{iso}", "plain", "{seq}{seq:2}.{ext}", "{lens:3}{", "{Date}", "{x}{y}")


@query("template_check", f"""WITH t AS (SELECT p_partkey, [{", ".join("'" + t + "'" for t in TEMPLATES)}][(p_partkey % {len(TEMPLATES)})::INT + 1] || CASE WHEN p_size % 10 = 0 THEN '{{day}}' ELSE '' END AS t FROM part),
  x AS (SELECT *, regexp_extract_all(t, '[{{]([a-zA-Z]+)(?::[0-9]+)?[}}]', 1) AS names FROM t), u AS (SELECT *, list_filter(names, lambda n: n NOT IN {text.CAPTURE_TOKENS + text.OTHER_TOKENS}) AS unknown FROM x)
  SELECT p_partkey, len(names)::INT AS n_tokens, len(list_filter(names, lambda n: n IN {text.CAPTURE_TOKENS})) > 0 AS needs_capture, CASE WHEN t = '' THEN 'the template gives an empty name' WHEN len(unknown) > 0 THEN 'there is no token {{' || unknown[1] || '}}' END AS problem FROM u""")
def template_check(spark, sf_dir):
    """Templates of file names: their tokens, whether they need metadata, and what is wrong with them."""
    p = table(spark, sf_dir, "part")
    t = F.concat(F.get(F.array(*map(F.lit, TEMPLATES)), (F.col("p_partkey") % len(TEMPLATES)).cast("int")), F.when(F.col("p_size") % 10 == 0, "{day}").otherwise(""))
    return p.select("p_partkey", F.size(text.tokens(t)).alias("n_tokens"), text.needs_capture(t).alias("needs_capture"), text.problem(t).alias("problem"))


@query("sanitize", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(url, '[\\/:*?"<>|\s]+', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS name FROM pages""")
def sanitize(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.sanitized(F.col("url")).alias("name"))


@query("clauses", "SELECT item_id, list_filter(list_transform(regexp_split_to_array(lower(text), '[.,;!?\\n]+'), lambda c: trim(c)), lambda c: c <> '') AS clauses FROM benchmark")
def clauses(spark, sf_dir):
    """A request in clauses, in lower case."""
    parts = F.transform(F.split(F.lower("text"), r"[.,;!?\n]+"), lambda c: F.trim(c))
    return table(spark, sf_dir, "benchmark").select("item_id", F.filter(parts, lambda c: c != "").alias("clauses"))


#: What the queries below add to a text, in turn: requests, captions, and what is seen (label and box).
REQUESTS = (
    "Heavier paper, and a wider border", "No gloss!", "cream stock plus cold ink", "bigger copy; thinner sheet", "not more paper", "a warm print however no white edge", "glossy? more sheen", "narrower margin, wider margin",
    "wider and narrower border wider margin narrower", "Une belle image", "hardly any shine and cut down the format", "",
)
CAPTIONS = ("Workers at the anvil in a smithy, cellar and attic", "a clerk posing in the street, the yard behind", "the train at the station", "a bell in a hall", "Pupils in class, school yard", "")
SEEN = ((("Worker", 0.1, 0.1, 0.7, 0.9), ("worker's cap", 0.2, 0.3, 0.6, 0.8), ("anvil", 0.6, 0.5, 0.99, 0.9)), (("clerk", 0.4, 0.4, 0.5, 0.5), ("face", 0.4, 0.4, 0.6, 0.6)), (("Steam Engine", 0.5, 0.5, 0.9, 0.9), ("tender", 0.0, 0.0, 0.3, 0.3), ("lamp", 0.0, 0.0, 0.1, 0.1)), (("pupil", 0.0, 0.0, 0.9, 0.9), ("bell", 0.2, 0.2, 0.4, 0.4)), (("bell", 0.2, 0.2, 0.4, 0.4), ("pupil", 0.5, 0.5, 0.9, 0.9)))


def _texts(values) -> str:
    """A list of texts in SQL."""
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _rows(values) -> str:
    """Rows of a table in SQL."""
    plain = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "VALUES " + ", ".join("(" + ", ".join(plain(v) for v in row) + ")" for row in values)


@query("intent_parse", f"""WITH t(term, kind, name) AS ({_rows((t, *x) for t, x in language.PRINTS.terms.items())}), rules(place, object, act, negated, intent, control, priority) AS ({_rows((i, r.object, r.act, int(r.negated), r.intent, r.control, r.priority) for i, r in enumerate(language.PRINTS.rules))}),
  c AS (SELECT conv_id, turn, k, trim(parts[k]) AS clause FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS k FROM (SELECT conv_id, turn, regexp_split_to_array(regexp_replace(regexp_replace(strip_accents(lower({_texts(REQUESTS)}[(conv_id % {len(REQUESTS)})::INT + 1] || chr(10) || text)), '[’''`]', ' ', 'g'), '[ \t\r\x0b\f]+', ' ', 'g'), '[.,;:!?\n]+| (?:{"|".join(language.PRINTS.breaks)})\\b') AS parts FROM conversations)) WHERE trim(parts[k]) <> ''),
  w AS (SELECT *, ' ' || array_to_string(regexp_extract_all(clause, '[a-z0-9]+'), ' ') || ' ' AS words FROM c), x AS (SELECT conv_id, turn, k, kind, name FROM w JOIN t ON contains(words, ' ' || term || ' ')),
  n AS (SELECT conv_id, turn, k, max((kind = 'negation')::INT) AS negated FROM x GROUP BY 1, 2, 3),
  hit AS (SELECT DISTINCT o.conv_id, o.turn, o.k, r.place, r.intent, r.control, r.priority FROM x o JOIN n USING (conv_id, turn, k) JOIN rules r ON o.kind = 'object' AND o.name = r.object AND n.negated = r.negated LEFT JOIN x a ON a.conv_id = o.conv_id AND a.turn = o.turn AND a.k = o.k AND a.kind = 'act' AND a.name = r.act WHERE r.act IS NULL OR a.name IS NOT NULL),
  kept AS (SELECT * FROM (SELECT *, max(priority) OVER (PARTITION BY conv_id, turn, k, control) AS top FROM hit) WHERE priority = top),
  first AS (SELECT conv_id, turn, intent, min(k * 1000 + place) AS nth FROM kept GROUP BY 1, 2, 3), i AS (SELECT conv_id, turn, string_agg(intent, ',' ORDER BY nth) AS intents FROM first GROUP BY 1, 2),
  two AS (SELECT DISTINCT a.conv_id, a.turn FROM kept a JOIN kept b USING (conv_id, turn) JOIN (SELECT unnest({_texts(a for a, _ in language.PRINTS.conflicts)}) AS up, unnest({_texts(b for _, b in language.PRINTS.conflicts)}) AS down) ON a.intent = up AND b.intent = down),
  u AS (SELECT conv_id, turn, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM kept WHERE kept.conv_id = c.conv_id AND kept.turn = c.turn AND kept.k = c.k) GROUP BY 1, 2)
  SELECT conv_id, turn, coalesce(intents, '') AS intents, two.conv_id IS NOT NULL AS contradicted, coalesce(n, 0) AS n_unmatched FROM conversations LEFT JOIN i USING (conv_id, turn) LEFT JOIN two USING (conv_id, turn) LEFT JOIN u USING (conv_id, turn)""")
def intent_parse(spark, sf_dir):
    """Intents that the clauses of a text ask for by a lexicon, whether they contradict each other, and how many clauses
    say nothing known."""
    said = F.get(F.array(*map(F.lit, REQUESTS)), (F.col("conv_id") % len(REQUESTS)).cast("int"))
    c = table(spark, sf_dir, "conversations").withColumn("_r", language.requested(F.concat(said, F.lit("\n"), "text"), language.PRINTS))
    return c.select("conv_id", "turn", F.array_join(F.col("_r")["intents"], ",").alias("intents"), language.contradicted(F.col("_r")["intents"], language.PRINTS).alias("contradicted"), F.size(F.col("_r")["unmatched"]).cast("long").alias("n_unmatched"))


def _seen_sql() -> str:
    label = lambda o: o[0].lower().replace("'", "''")
    boxes = ", ".join("[" + ", ".join(f"{{'label': '{label(o)}', 'x0': {o[1]}::DOUBLE, 'y0': {o[2]}::DOUBLE, 'x1': {o[3]}::DOUBLE, 'y1': {o[4]}::DOUBLE}}" for o in frame) + "]" for frame in SEEN)
    return f"[{boxes}]"


_INSIDE = "(greatest(0, least(o.o.x1, p.x1) - greatest(o.o.x0, p.x0)) * greatest(0, least(o.o.y1, p.y1) - greatest(o.o.y0, p.y0))) / ((o.o.x1 - o.o.x0) * (o.o.y1 - o.o.y0))"
_A = language.ARCHIVE
_COUNT = lambda terms: f"len(list_filter(said, lambda x: list_contains({_texts(sorted(terms))}, x)))"
_PLACES = list(_A.places)


@query("scene_keywords", f"""WITH c AS (SELECT doc_id, regexp_extract_all(strip_accents(lower({_texts(CAPTIONS)}[(doc_id % {len(CAPTIONS)})::INT + 1] || ' ' || coalesce(text, ''))), '[a-z0-9]+') AS said, {_seen_sql()}[(doc_id % {len(SEEN)})::INT + 1] AS seen FROM documents),
  o AS (SELECT doc_id, k, seen, seen[k] AS o FROM (SELECT doc_id, seen, unnest(range(1, len(seen) + 1)) AS k FROM c)),
  w AS (SELECT doc_id, k, o.o AS o, list_contains({_texts(_A.persons)}, o.o.label) AS person, (o.o.x1 - o.o.x0) * (o.o.y1 - o.o.y0) AS area, len(list_filter(seen, lambda p: list_contains({_texts(_A.persons)}, p.label) AND p <> o.o AND {_INSIDE} > {language.WORN})) > 0 AS worn FROM o),
  f AS (SELECT doc_id, bool_or(person) AS people, bool_or(person AND area > {language.LARGE_PERSON}) OR bool_or(o.label = '{_A.face}' AND area > {language.LARGE_FACE}) AS big, coalesce(list(o.label) FILTER (worn), []) AS worn, coalesce(list(o.label) FILTER (NOT worn), []) AS free,
    coalesce(list(CASE o.label {" ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _A.renamed)} ELSE o.label END ORDER BY k) FILTER (NOT list_contains({_texts(_A.parts)}, o.label) AND area >= {language.LEAST_AREA} AND (person OR NOT worn)), []) AS shown FROM w GROUP BY 1),
  n AS (SELECT *, {_COUNT(_A.places[_PLACES[0]])} AS p0, {_COUNT(_A.places[_PLACES[1]])} AS p1 FROM c JOIN f USING (doc_id)),
  a AS (SELECT doc_id, list_concat(list_filter([CASE WHEN people AND ({_COUNT(_A.portrait)} > 0 OR big) THEN 'portrait' END, {"".join(f"CASE WHEN {_COUNT(t)} > 0 AND NOT (list_contains(worn, '{n}') AND NOT list_contains(free, '{n}')) THEN '{n}' END, " for n, t in _A.scenes.items())} CASE WHEN p0 > p1 THEN '{_PLACES[0]}' WHEN p1 > p0 THEN '{_PLACES[1]}' END], lambda x: x IS NOT NULL), shown) AS k FROM n)
  SELECT doc_id, array_to_string(list_filter(k, lambda x, j: list_position(k, x) = j)[1:{language.MAX_KEYWORDS}], ',') AS keywords FROM a""")
def scene_keywords(spark, sf_dir):
    """Keywords of a frame from its caption and what is seen in it, by a table of scenes."""
    pick = lambda values, n: F.get(F.array(*values), (F.col("doc_id") % n).cast("int"))
    box = lambda o: F.struct(F.lit(o[0]).alias("label"), *[F.lit(float(v)).alias(n) for n, v in zip(("x0", "y0", "x1", "y1"), o[1:], strict=True)])
    caption = F.concat(pick(map(F.lit, CAPTIONS), len(CAPTIONS)), F.lit(" "), F.coalesce("text", F.lit("")))
    seen = pick([F.array(*map(box, frame)) for frame in SEEN], len(SEEN))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(language.keywords(caption, seen, language.ARCHIVE), ",").alias("keywords"))


@query("loc_boxes", "SELECT l_orderkey, l_linenumber, l_partkey, count(*) AS n, (max(l_quantity) + 0.5) / 1000 * 48 AS x FROM lineitem GROUP BY 1, 2, 3")
def loc_boxes(spark, sf_dir):
    """Location tokens in a text as coordinates of an extent of 48."""
    said = F.concat(F.lit("<loc_"), F.col("q").cast("int"), F.lit(">"))
    found = F.regexp_extract_all("said", F.lit(r"<loc_(\d+)>"), 1)
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q")).withColumn("said", said)
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "n", F.transform(found, lambda v: (v.cast("double") + 0.5) / 1000 * 48)[0].alias("x"))


@query("mirror_dest", "SELECT page_id, CASE WHEN starts_with(url, 'https://') THEN 'https/' || url[9:] ELSE regexp_extract(url, '[^/]*$') END AS dest FROM pages")
def mirror_dest(spark, sf_dir):
    """The path below a root, or the last part of one that is outside."""
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.when(url.startswith("https://"), F.concat(F.lit("https/"), F.substr(url, F.lit(9)))).otherwise(F.regexp_extract(url, "[^/]*$", 0)).alias("dest"))


@query("store_name", "SELECT source, max(doc_id) AS top, source || '-' || sha256(source)[1:8] AS name FROM documents GROUP BY 1")
def store_name(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.max("doc_id").alias("top"))
    return d.select("source", "top", F.concat("source", F.lit("-"), F.left(F.sha2("source", 256), F.lit(8))).alias("name"))


@query("checksum", "SELECT doc_id, sha256(text) AS digest FROM documents")
def checksum(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("common_folder", "SELECT s_nationkey, CASE WHEN count(DISTINCT s_suppkey % 3) = 1 THEN '/a/b' || min(s_suppkey % 3) ELSE '/a' END AS folder FROM supplier GROUP BY 1")
def common_folder(spark, sf_dir):
    """The longest folder that all files of a group are under."""
    path = F.concat(F.lit("/a/b"), F.col("s_suppkey") % 3, F.lit("/x"))
    # what the first and the last path in order share, all between them share
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(text.common_folder(F.array(F.min(path), F.max(path))).alias("folder"))


@query("render_key", "SELECT DISTINCT p_brand || ' + ' || p_type AS key, p_brand AS profile, p_type AS look FROM part")
def render_key(spark, sf_dir):
    """Profile and look as one key, and back at the first separator."""
    keys = table(spark, sf_dir, "part").select(F.concat_ws(" + ", "p_brand", "p_type").alias("key")).distinct()
    return keys.select("key", F.substring_index("key", " + ", 1).alias("profile"), F.expr("substr(key, instr(key, ' + ') + 3)").alias("look"))


@query("human_bytes", "SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE (floor(n_chars / 1024.0 * 10 + 0.5) / 10)::DOUBLE || ' KB' END AS size FROM documents WHERE n_chars < 1048576")
def human_bytes(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("n_chars < 1048576").select("doc_id", text.human_bytes(F.col("n_chars")).alias("size"))


@query("parse_size", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size * 1024 WHEN 1 THEN p_size * 1048576 WHEN 2 THEN p_size::BIGINT ELSE 1073741824 END AS bytes FROM part")
def parse_size(spark, sf_dir):
    said = F.when(F.col("p_partkey") % 4 == 0, F.concat("p_size", F.lit("KB"))).when(F.col("p_partkey") % 4 == 1, F.concat("p_size", F.lit(" mb"))).when(F.col("p_partkey") % 4 == 2, F.col("p_size").cast("string")).otherwise("plenty")
    return table(spark, sf_dir, "part").select("p_partkey", text.parsed_size(F.upper(said), 1 << 30).alias("bytes"))


@query("exif_date", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS taken FROM orders")
def exif_date(spark, sf_dir):
    """Colon dates, read without a zone."""
    said = F.date_format("o_orderdate", "yyyy:MM:dd HH:mm:ss")
    iso = F.regexp_replace(said, r"^(\d{4})[:-](\d{2})[:-](\d{2})", "$1-$2-$3")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(F.to_timestamp_ntz(iso, F.lit("yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd HH:mm:ss").alias("taken"))


@query("capture_hour", "SELECT event_id, hour(ts)::INT AS hour FROM events")
def capture_hour(spark, sf_dir):
    said = F.date_format("ts", "yyyy:MM:dd HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract(said, r" (\d{2}):", 1).try_cast("int").alias("hour"))


@query("asshot_features", "WITH h AS (SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN hour(ts) END AS h FROM events) SELECT event_id, floor(coalesce(sin(2 * pi() * h / 24), 0) * 1e6 + 0.501) / 1e6 AS s, floor(coalesce(cos(2 * pi() * h / 24), 0) * 1e6 + 0.501) / 1e6 AS c FROM h")
def asshot_features(spark, sf_dir):
    """The hour on a circle; an unknown hour is its centre."""
    angle = F.when(F.col("event_id") % 5 != 0, F.hour("ts")) * F.lit(2.0) * F.pi() / 24
    at = lambda f: r6(F.coalesce(f(angle), F.lit(0.0)))
    return table(spark, sf_dir, "events").select("event_id", at(F.sin).alias("s"), at(F.cos).alias("c"))


@query("num_coerce", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size::DOUBLE WHEN p_partkey % 3 = 1 THEN -1.0 / p_size END AS number FROM part")
def num_coerce(spark, sf_dir):
    """Numbers as they are written: plain, as a rational, or not at all."""
    said = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), "p_size")).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("-1/"), "p_size")).otherwise("unknown")
    return table(spark, sf_dir, "part").select("p_partkey", text.number_of(said).alias("number"))


def encoded(value, reference, log_scale: bool):
    """A value's distance from its reference, in logarithms for a colour temperature."""
    safe = lambda x: F.log(F.greatest(x, F.lit(1.0)))
    return safe(value) - safe(reference) if log_scale else value - reference


def decoded(delta, reference, low: float, high: float, log_scale: bool):
    raw = F.exp(delta + F.log(F.greatest(reference, F.lit(1.0)))) if log_scale else delta + reference
    return clamp(raw, low, high)


@query("delta_roundtrip", "SELECT o_orderkey, floor(ln(o_totalprice / 5000) * 1e6 + 0.501) / 1e6 AS delta, floor(least(greatest(o_totalprice, 2000), 50000) * 100 + 0.5) / 100 AS back FROM orders WHERE o_totalprice >= 1")
def delta_roundtrip(spark, sf_dir):
    delta = encoded(F.col("o_totalprice"), F.lit(5000.0), True)
    back = decoded(delta, F.lit(5000.0), 2000.0, 50000.0, True)
    return table(spark, sf_dir, "orders").filter("o_totalprice >= 1").select("o_orderkey", r6(delta).alias("delta"), round_half_up(back, 2).alias("back"))


@query("apply_offset", "SELECT l_orderkey, l_partkey, l_linenumber, count(*) AS n, least(greatest(max(l_quantity) + 2.5, 0), 50) AS value FROM lineitem GROUP BY 1, 2, 3")
def apply_offset(spark, sf_dir):
    """A calibration offset, added in the space of the correction and clamped."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max("l_quantity").alias("q"))
    return li.select("l_orderkey", "l_partkey", "l_linenumber", "n", decoded(F.col("q") + 2.5, F.lit(0.0), 0.0, 50.0, False).alias("value"))


@query("linear_merit", "SELECT vec_id, floor(1 / (1 + exp(-(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * (i % 3)))))) * 1e6 + 0.501) / 1e6 AS merit FROM embeddings")
def linear_merit(spark, sf_dir):
    """The logistic of a linear head."""
    weights = F.array(*[F.lit(float(i % 3)) for i in range(1, 65)])
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(logistic(arrays.dot(arrays.doubles(F.col("embedding")), weights))).alias("merit"))


@query("heuristic_merit", "SELECT p_partkey, floor(least(1, greatest(0, 0.5 * (1 - abs(p_size / 50.0 - 0.5) * 2) + 0.3 * least(1, p_retailprice / 2000) + 0.2 * (p_partkey % 10) / 10.0)) * 1e6 + 0.501) / 1e6 AS merit FROM part")
def heuristic_merit(spark, sf_dir):
    """A rough merit of brightness, contrast and colour."""
    bright = 1 - F.abs(F.col("p_size") / 50.0 - 0.5) * 2
    merit = bright * 0.5 + F.least(F.lit(1.0), F.col("p_retailprice") / 2000) * 0.3 + (F.col("p_partkey") % 10) * 0.2 / 10.0
    return table(spark, sf_dir, "part").select("p_partkey", r6(clamp(merit, 0.0, 1.0)).alias("merit"))


@query("focus_score", "SELECT p_partkey, p_retailprice / (p_retailprice + 250) AS focus FROM part")
def focus_score(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") / (F.col("p_retailprice") + 250)).alias("focus"))


@query("anchor_apply", "WITH x AS (SELECT o_orderkey, log2(o_totalprice / 20000) AS x FROM orders WHERE o_totalprice > 0) SELECT o_orderkey, floor((CASE WHEN x > 0.5 THEN (x - 0.5) * 2 WHEN x < -0.5 THEN (x + 0.5) * 3 ELSE 0 END) * 1e6 + 0.501) / 1e6 AS y FROM x")
def anchor_apply(spark, sf_dir):
    """A dead zone, and a gain on either side of it."""
    x = F.log2(F.col("o_totalprice") / 20000)
    y = F.greatest(x - 0.5, F.lit(0.0)) * 2 + F.least(x + 0.5, F.lit(0.0)) * 3
    return table(spark, sf_dir, "orders").filter("o_totalprice > 0").select("o_orderkey", r6(y).alias("y"))


@query("response_clamp", "SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 1.0 ELSE least(3.0, greatest(0.0, p_size / 10.0 - 1)) END AS response FROM part")
def response_clamp(spark, sf_dir):
    """A response between 0 and its limit; no number counts as 1."""
    raw = F.when(F.col("p_partkey") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("p_size") / 10.0 - 1)
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.isnan(raw), 1.0).otherwise(clamp(raw, 0.0, 3.0)).alias("response"))


@query("mired", "SELECT p_partkey, floor((1e6 / (p_retailprice * 3) - 1e6 / 5500) * 1e4 + 0.501) / 1e4 AS shift FROM part")
def mired(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r4(color.mired(F.col("p_retailprice") * 3) - color.mired(F.lit(5500.0))).alias("shift"))


_KELVIN = """t AS (SELECT p_partkey, least(greatest(p_retailprice * 4, 1667.0), 25000.0) AS t FROM part),
  x AS (SELECT *, CASE WHEN t <= 4000 THEN -0.2661239e9 / (t * t * t) - 0.2343589e6 / (t * t) + 0.8776956e3 / t + 0.179910 ELSE -3.0258469e9 / (t * t * t) + 2.1070379e6 / (t * t) + 0.2226347e3 / t + 0.240390 END AS x FROM t),
  y AS (SELECT *, CASE WHEN t <= 2222 THEN x * x * x * -1.1063814 - x * x * 1.34811020 + x * 2.18555832 - 0.20219683 WHEN t <= 4000 THEN x * x * x * -0.9549476 - x * x * 1.37418593 + x * 2.09137015 - 0.16748867 ELSE x * x * x * 3.0817580 - x * x * 5.87338670 + x * 3.75112997 - 0.37001483 END AS y FROM x),
  c AS (SELECT p_partkey, 1 / greatest(x / y * 3.2406 - 1.5372 - (1 - x - y) / y * 0.4986, 1e-6) AS r, 1 / greatest(x / y * -0.9689 + 1.8758 + (1 - x - y) / y * 0.0415, 1e-6) AS g, 1 / greatest(x / y * 0.0557 - 0.2040 + (1 - x - y) / y * 1.0570, 1e-6) AS b FROM y)"""


@query("wb_gains", f"WITH {_KELVIN}, l AS (SELECT *, r * 0.2126 + g * 0.7152 + b * 0.0722 AS l FROM c) SELECT p_partkey, floor(r / l * 1e6 + 0.501) / 1e6 AS r, floor(g / l * 1e6 + 0.501) / 1e6 AS g, floor(b / l * 1e6 + 0.501) / 1e6 AS b FROM l".replace("0.2661239e9", "266123900.0::DOUBLE").replace("0.2343589e6", "234358.9::DOUBLE").replace("0.8776956e3", "877.6956::DOUBLE").replace("3.0258469e9", "3025846900.0::DOUBLE").replace("2.1070379e6", "2107037.9::DOUBLE").replace("0.2226347e3", "222.6347::DOUBLE"))
def wb_gains(spark, sf_dir):
    """Channel gains for a black body's light; at unit luminance."""
    gains = color.balance_gains(F.col("p_retailprice") * 4)
    return table(spark, sf_dir, "part").select("p_partkey", *[r6(F.get(gains, i)).alias(c) for i, c in enumerate("rgb")])


@query("srgb", "SELECT p_partkey, floor((CASE WHEN p_size / 50.0 <= 0.0031308 THEN p_size / 50.0 * 12.92 ELSE pow(p_size / 50.0, 1 / 2.4) * 1.055 - 0.055 END) * 1e6 + 0.501) / 1e6 AS v FROM part")
def srgb(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", r6(color.srgb_encoded(F.col("p_size") / 50.0)).alias("v"))


@query("rgb_hsv", """WITH c AS (SELECT p_partkey, p_size / 50.0 AS r, p_partkey % 7 / 7.0 AS g, p_partkey % 11 / 11.0 AS b FROM part), m AS (SELECT *, greatest(r, g, b) AS mx, greatest(r, g, b) - least(r, g, b) AS d FROM c),
  h AS (SELECT p_partkey, mx, d, CASE WHEN d = 0 THEN 0 WHEN mx = r THEN (g - b) / d WHEN mx = g THEN (b - r) / d + 2 ELSE (r - g) / d + 4 END * 60 AS h FROM m)
  SELECT p_partkey, floor((CASE WHEN h < 0 THEN h + 360 ELSE h END) * 1e4 + 0.501) / 1e4 AS hue, floor((CASE WHEN mx = 0 THEN 0 ELSE d / mx END) * 1e4 + 0.501) / 1e4 AS saturation FROM h""")
def rgb_hsv(spark, sf_dir):
    v = color.hsv(F.col("p_size") / 50.0, F.col("p_partkey") % 7 / 7.0, F.col("p_partkey") % 11 / 11.0)
    return table(spark, sf_dir, "part").select("p_partkey", v.alias("v")).select("p_partkey", r4(F.col("v.hue")).alias("hue"), r4(F.col("v.saturation")).alias("saturation"))


@query("shape_log", """WITH s AS (SELECT p_partkey, (p_size / 5.0 - 5 + 0.25) * 1.2 AS s FROM part), t AS (SELECT *, least(1, greatest(0, s / 4)) AS a, least(1, greatest(0, (s + 4) / 4)) AS b FROM s)
  SELECT p_partkey, floor((s - 0.5 * (a * a * (3 - 2 * a)) + 0.4 * (1 - b * b * (3 - 2 * b))) * 1e6 + 0.501) / 1e6 AS v FROM t""")
def shape_log(spark, sf_dir):
    v = color.shaped_log(F.col("p_size") / 5.0 - 5, F.lit(0.25), F.lit(0.2), F.lit(-0.5), F.lit(0.4))
    return table(spark, sf_dir, "part").select("p_partkey", r6(v).alias("v"))


@query("dng_to_srgb", "WITH x AS (SELECT p_partkey, least(1, greatest(0, (p_size - 2) / 46.0 / 0.9)) AS v FROM part) SELECT p_partkey, floor((CASE WHEN v <= 0.0031308 THEN v * 12.92 ELSE pow(v, 1 / 2.4) * 1.055 - 0.055 END) * 255 + 0.5)::INT AS v FROM x")
def dng_to_srgb(spark, sf_dir):
    """Black and white level, as-shot gain, encoding, eight bits."""
    linear = clamp((F.col("p_size") - 2) / 46.0 / 0.9, 0.0, 1.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.floor(color.srgb_encoded(linear) * 255 + 0.5).cast("int").alias("v"))


@query("parse_hhmm", "SELECT p_partkey, CASE WHEN p_size < 24 AND p_partkey % 90 < 60 THEN p_size * 60 + p_partkey % 90 END AS minutes FROM part")
def parse_hhmm(spark, sf_dir):
    said = F.concat("p_size", F.lit(":"), F.lpad((F.col("p_partkey") % 90).cast("string"), 2, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", text.parsed_time(said).cast("long").alias("minutes"))


@query("format_value", "SELECT p_partkey, printf('%+.2f', (p_size - 25) / 4.0) AS exposure, floor((p_size - 25) / 4.0 + 0.5)::BIGINT::VARCHAR AS other FROM part")
def format_value(spark, sf_dir):
    """Slider text: exposure signed with two decimals, others whole."""
    v = (F.col("p_size") - 25) / 4.0
    return table(spark, sf_dir, "part").select("p_partkey", F.format_string("%+.2f", v).alias("exposure"), round_half_up(v).cast("long").cast("string").alias("other"))


@query("elo_expected", "SELECT s_suppkey, floor(1 / (1 + pow(10, (1500 - (1500 + (s_acctbal / 10000 - 0.5) * 400)) / 400)) * 1e6 + 0.501) / 1e6 AS expected FROM supplier")
def elo_expected(spark, sf_dir):
    seed = (F.col("s_acctbal") / 10000 - 0.5) * 400 + 1500
    return table(spark, sf_dir, "supplier").select("s_suppkey", r6(1 / (1 + F.pow(F.lit(10.0), (1500 - seed) / 400))).alias("expected"))


@query("l2norm", "SELECT vec_id, floor(list_sum(list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))) * 1e6 + 0.501) / 1e6 AS total FROM embeddings")
def l2norm(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", arrays.doubles(F.col("embedding")).alias("x")).withColumn("n", arrays.norm(F.col("x")))
    return e.select("vec_id", r6(arrays.total(F.transform("x", lambda v: v / F.col("n")))).alias("total"))


@query("cosine", "SELECT a.vec_id, floor(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) * 1e6 + 0.501) / 1e6 AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", arrays.doubles(F.col("embedding")).alias("x"))
    other = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return e.join(other, "vec_id").select("vec_id", r6(arrays.dot(F.col("x"), F.col("y"))).alias("dot"))


@query("aspect_merit", "WITH s AS (SELECT vec_id, list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * CASE WHEN i % 2 = 1 THEN 1 ELSE -1 END)) AS d FROM embeddings) SELECT vec_id, floor(1 / (1 + exp(-100 * d / 64)) * 1e6 + 0.501) / 1e6 AS merit FROM s")
def aspect_merit(spark, sf_dir):
    """The logistic of the gap between a positive and a negative prompt."""
    signs = F.array(*[F.lit(1.0 if i % 2 == 0 else -1.0) for i in range(64)])
    return table(spark, sf_dir, "embeddings").select("vec_id", r6(logistic(arrays.dot(arrays.doubles(F.col("embedding")), signs) * 100 / 64)).alias("merit"))


@query("curve_sample", "SELECT p_partkey, floor((p_size / 2.0 + (100 - p_size / 2.0) * (64 - 32) / 160.0) * 1e6 + 0.501) / 1e6 AS at64, (p_size / 2.0)::DOUBLE AS at0, 100.0::DOUBLE AS at255 FROM part")
def curve_sample(spark, sf_dir):
    """A tone curve through (192, 100) and (32, size / 2) at three knots."""
    point = lambda x, y: F.struct(F.lit(float(x)).alias("x"), y.cast("double").alias("y"))
    c = arrays.sampled_curve(F.array(point(192, F.lit(100.0)), point(32, F.col("p_size") / 2.0)), [64, 0, 255])
    return table(spark, sf_dir, "part").select("p_partkey", c.alias("c")).select("p_partkey", r6(F.get("c", 0)).alias("at64"), F.get("c", 1).alias("at0"), F.get("c", 2).alias("at255"))


@query("one_hot", "SELECT o_orderkey, (o_orderstatus = 'F')::INT::DOUBLE AS f, (o_orderstatus = 'O')::INT::DOUBLE AS o FROM orders")
def one_hot(spark, sf_dir):
    hot = arrays.one_hot(F.col("o_orderstatus"), ["F", "O"])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.get(hot, 0).alias("f"), F.get(hot, 1).alias("o"))


@query("heat_levels", "SELECT vec_id, floor(list_sum(list_transform(embedding, lambda x: sqrt(greatest(x::DOUBLE, 0) / list_max(embedding)::DOUBLE))) * 1e6 + 0.501) / 1e6 AS heat FROM embeddings WHERE list_max(embedding) > 0")
def heat_levels(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").filter(F.array_max("embedding") > 0)
    return e.select("vec_id", r6(arrays.total(arrays.heat(arrays.doubles(F.col("embedding"))))).alias("heat"))


@query("heat_grid", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: floor(sqrt(greatest(x::DOUBLE, 0) / list_max(embedding)::DOUBLE) * 4 + 0.5)))::BIGINT AS heat FROM embeddings WHERE list_max(embedding) > 0")
def heat_grid(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").filter(F.array_max("embedding") > 0)
    levels = arrays.heat(arrays.doubles(F.col("embedding")), 5)
    return e.select("vec_id", F.aggregate(levels, F.lit(0).cast("long"), lambda a, v: a + v.cast("long")).alias("heat"))


@query("orient_grid", "SELECT vec_id, list_transform(range(64), lambda i: embedding[(7 - i % 8) * 8 + i // 8 + 1]::DOUBLE) AS grid FROM embeddings")
def orient_grid(spark, sf_dir):
    """An 8 x 8 grid turned as its orientation says."""
    return table(spark, sf_dir, "embeddings").select("vec_id", arrays.oriented(arrays.doubles(F.col("embedding")), 8, 8, 6).alias("grid"))


@query("mask_share", "SELECT vec_id, list_sum(list_transform(embedding, lambda x: (x > 0)::INT)) / 64.0 AS share FROM embeddings")
def mask_share(spark, sf_dir):
    """A bitmask packed from a grid, and the share that is set."""
    bits = F.aggregate(F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v))
    return table(spark, sf_dir, "embeddings").select("vec_id", (F.bit_count(bits) / 64.0).alias("share"))


@query("box_overlap", "SELECT l_orderkey, l_partkey, l_linenumber, count(*) AS n, max(greatest(0, least(l_quantity + 10, 40) - greatest(l_quantity, 20)) / 10) AS share FROM lineitem GROUP BY 1, 2, 3")
def box_overlap(spark, sf_dir):
    share = F.greatest(F.lit(0.0), F.least(F.col("l_quantity") + 10, F.lit(40.0)) - F.greatest(F.col("l_quantity"), F.lit(20.0))) / 10
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_partkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.max(share).alias("share"))


@query("look_percentile", "WITH v AS (SELECT user_id, value, sum(value) OVER (PARTITION BY user_id ORDER BY value, event_id) AS seen, sum(value) OVER (PARTITION BY user_id) AS total FROM events) SELECT user_id, min(value) AS p50 FROM v WHERE seen >= 0.5 * total GROUP BY 1")
def look_percentile(spark, sf_dir):
    """The weighted lower percentile of a look."""
    return feedback.weighted_percentile(table(spark, sf_dir, "events"), "user_id", "value", F.col("value"), 0.5).withColumnRenamed("percentile", "p50")


@query("violation", "SELECT p_partkey, greatest(0, 10 - p_size) + greatest(0, p_size - 40) AS violation FROM part")
def violation(spark, sf_dir):
    """How far a figure is outside its bounds."""
    return table(spark, sf_dir, "part").select("p_partkey", (F.greatest(F.lit(0), 10 - F.col("p_size")) + F.greatest(F.lit(0), F.col("p_size") - 40)).alias("violation"))


@query("anchor_ramp", "SELECT p_partkey, s / 20.0::DOUBLE AS scale, p_size * s / 20.0::DOUBLE AS value FROM part, range(0, 61) r(s)")
def anchor_ramp(spark, sf_dir):
    """A parameter at 61 strengths from 0 to 3."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", "p_size", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("s")).select("p_partkey", (F.col("s") / 20).alias("scale"), (F.col("p_size") * F.col("s") / 20).alias("value"))


@query("luma_hist", "WITH c AS (SELECT label, floor(log2(greatest(x::DOUBLE * x::DOUBLE, 1e-9)) * 16)::BIGINT AS bin FROM (SELECT label, unnest(embedding) AS x FROM embeddings)) SELECT label, bin, count(*) AS n FROM c GROUP BY 1, 2")
def luma_hist(spark, sf_dir):
    """A histogram in sixteenths of a stop."""
    x = table(spark, sf_dir, "embeddings").select("label", F.explode(arrays.doubles(F.col("embedding"))).alias("x"))
    bin = F.floor(F.log2(F.greatest(F.col("x") * F.col("x"), F.lit(1e-9))) * 16)
    return x.groupBy("label", bin.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("laplacian", """WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 127 + 128)::BIGINT) AS p FROM embeddings),
  l AS (SELECT vec_id, list_transform(range(36), lambda k: p[(k // 6 + 1) * 8 + k % 6 + 1] + p[(k // 6 + 1) * 8 + k % 6 + 3] + p[(k // 6) * 8 + k % 6 + 2] + p[(k // 6 + 2) * 8 + k % 6 + 2] - 4 * p[(k // 6 + 1) * 8 + k % 6 + 2]) AS l FROM p)
  SELECT vec_id, floor((list_sum(list_transform(l, lambda x: x * x)) / 36.0::DOUBLE - pow(list_sum(l) / 36.0::DOUBLE, 2)) * 1e3 + 0.501) / 1e3 AS score, 1 AS n_tiles, floor((list_sum(list_transform(l, lambda x: x * x)) / 36.0::DOUBLE - pow(list_sum(l) / 36.0::DOUBLE, 2)) * 1e3 + 0.501) / 1e3 AS peak FROM l""")
def laplacian(spark, sf_dir):
    """Focus of 8 x 8 rasters: variance of the Laplacian, by tile and its peak; a raster so small is one tile."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 127 + 128).cast("int")).alias("pixels"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    r3 = lambda c: (F.floor(F.col(c) * 1e3 + 0.501) / 1e3).alias(c)
    return raster.focus(e).select("vec_id", r3("score"), F.size("tiles").alias("n_tiles"), r3("peak"))


@query("color_features")
def color_features(spark, sf_dir):
    """Photometric figures of 8 x 8 rasters in three channels."""
    px = lambda k: F.transform("embedding", lambda x: F.abs(F.floor(x * (100 + k) + 128).cast("int")) % 256)
    return raster.photometry(table(spark, sf_dir, "embeddings").select("vec_id", px(0).alias("r"), px(20).alias("g"), px(-20).alias("b"), F.lit(8).alias("width"), F.lit(8).alias("height")))


# a triangle; a pixel's centre is inside if a ray to the right crosses its edges an odd number of times
@query("polygon_mask", """WITH t AS (SELECT p_partkey, p_size / 50.0::DOUBLE * 44 + 2 AS w FROM part), e AS (SELECT p_partkey, unnest([2.0, w, 24.0]) AS ax, unnest([2.0, 2.0, 46.0]) AS ay, unnest([w, 24.0, 2.0]) AS bx, unnest([2.0, 46.0, 2.0]) AS by_ FROM t),
  c AS (SELECT p_partkey, i, j, count(*) AS n FROM e, range(48) a(i), range(48) b(j) WHERE (ay > i + 0.5) <> (by_ > i + 0.5) AND j + 0.5 < (bx - ax) * (i + 0.5 - ay) / (by_ - ay) + ax GROUP BY 1, 2, 3)
  SELECT p_partkey, coalesce(n, 0) / 2304.0::DOUBLE AS share FROM part LEFT JOIN (SELECT p_partkey, count(*) AS n FROM c WHERE n % 2 = 1 GROUP BY 1) USING (p_partkey)""")
def polygon_mask(spark, sf_dir):
    """Polygons as masks by the even-odd rule, and the share they cover."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select("p_partkey", F.array(*[F.col("p_size") * 0.0 + v for v in (2.0, 2.0)], F.col("p_size") / 50.0 * 44 + 2, F.lit(2.0), F.lit(24.0), F.lit(46.0)).alias("points"))
    return raster.polygon_share(p, 48)


@query("codec_roundtrip", "SELECT vec_id, 4 * len(embedding) AS n_bytes, len(embedding) = 64 AS same FROM embeddings")
def codec_roundtrip(spark, sf_dir):
    """Vectors to little-endian bytes and back; the length is checked."""
    return raster.codec(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 64).select("vec_id", F.octet_length("bytes").cast("long").alias("n_bytes"), "same")
