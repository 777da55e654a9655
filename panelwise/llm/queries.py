"""Registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwise.llm import bpe, hamming, langid, licences, mixing, neardup, notices, packing, permutation, quality, resampling, urls, warc, whitening
from panelwise.llm.common import crc_mod, stored, word_count
from panelwise.session import literal_table, shared_folder


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_quality_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    stats = stored(quality.measured(docs, ["doc_id"]), "quality-statistics")
    model = quality.train(stats, labels.where(crc_mod(F.col("doc_id"), 4) != 2))
    return quality.score(stats, model, stats="stats") \
        .select("doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", "predicted")


def _sized(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return stored(docs.select(*columns, word_count(F.col("text")).alias("size")), "sizes")


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_sized(spark, sf_dir, "doc_id", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "quota_words", "stream_start")


def op3_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = langid.train(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    return langid.identify(docs.drop("lang"), model).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), F.size("language.spans").alias("n_spans"))


#: Fixed values of the query's contract: host, path prefix and verdict of each rule.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op4_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = literal_table(spark, URL_RULES, "host string, path string, verdict string")
    return urls.filter_urls(_read(spark, sf_dir, "pages").select("page_id", "url"), rules) \
        .select("page_id", "host", "path", "rule", "verdict")


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_read(spark, sf_dir, "documents"), width=2, percent=80)


def op6_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), hamming.sign_bits(F.col("embedding")).alias("bits"))
    return hamming.top_k(codes, codes.where("id % 100 = 0"), length=64, k=10) \
        .select("query_id", "rank", F.col("id").alias("vec_id"), F.col("distance").cast("int").alias("distance"))


def op7_permutation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return permutation.nearest(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op8_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_sized(spark, sf_dir, "doc_id"), "size") \
        .select("doc_id", "size", "bucket", "bucket_length", "batch", "slot", "padding")


def op9_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _read(spark, sf_dir, "pages").select("page_id", "url", "html")
    index, keepers, files = warc.archive_index(pages)
    archives = warc.write_archives(pages, keepers, files, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    return warc.read_records(index, archives).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's path is its host and URL path. Pages have no licence files, so every page with a notice speaks for its directory."""
    host, path = urls.host_and_path(F.col("url"))
    files = _read(spark, sf_dir, "pages").select("page_id", F.concat(host, path).alias("path"), "html")
    return licences.scan(files, "page_id", "path", licences.visible_text(F.col("html")), licence_file="")


def op10_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``op10_license_scan``, by cosine alone, with all templates, the table's own frequencies and counter-templates."""
    host, path = urls.host_and_path(F.col("url"))
    files = _read(spark, sf_dir, "pages").select("page_id", F.concat(host, path).alias("path"), "html")
    return notices.scan(files, "page_id", "path", licences.visible_text(F.col("html")), licence_file="")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per vector and component, numbered from 1 by falling variance."""
    white = whitening.whiten(_read(spark, sf_dir, "embeddings"), parts=8)
    return white.select("vec_id", "n", F.col("deviation").cast("long").alias("deviation"), "identity_error", "explained", F.posexplode("w").alias("_i", "whitened")) \
        .select("vec_id", (F.col("_i") + 1).alias("component"), "n", "deviation", "whitened", F.col("explained")[F.col("_i")].alias("explained"), "identity_error")


def vocabulary_path() -> str:
    """The byte-level vocabulary of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op12_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.load(vocabulary_path())
    ids = bpe.encode(_read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text")
    return bpe.decode(ids, vocabulary).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.ids_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


QUERIES = {f.__name__: f for f in (
    op1_quality_discriminant, op2_source_mix, op3_language_spans, op4_url_verdicts, op5_near_duplicates, op6_hamming_top_k,
    op7_permutation_search, op8_length_buckets, op9_warc_archives, op10_license_scan, op10_license_notices, op11_embedding_whitening, op12_bpe_round_trip,
    op13_importance_resampling)}

# --- DuckDB SQL where SQL can express a query; fitted models (1, 3), the approximate index (7), the packing optimum (8), eigenvectors (11) and
# exact merges (12) are tested otherwise ---

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_URL = rf"""u AS (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
v AS (SELECT *, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u)"""

_OP2 = rf"""WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][pos % 3 + 1] AS weight, sum(source_size) OVER () AS total FROM s),
lv AS (SELECT 0 AS i, 0.0::DOUBLE AS level UNION ALL
  SELECT i + 1, (any_value(total) - sum(CASE WHEN 3 * source_size < level * weight THEN 3 * source_size ELSE 0 END))::DOUBLE / sum(CASE WHEN 3 * source_size < level * weight THEN 0 ELSE weight END) FROM lv, w WHERE i < 25 GROUP BY i, level),
t AS (SELECT *, least(3.0::DOUBLE * source_size, (SELECT max(level) FROM lv) * weight) AS target FROM w),
b AS (SELECT greatest(1, least(1024, floor(min(target) FILTER (target > 0) / 200)))::BIGINT AS block, sum(target) AS whole FROM t),
h AS (SELECT block, round(whole / block)::BIGINT AS house, whole FROM b),
q AS (SELECT pos, target, unnest(range(1, floor(target / whole * house)::BIGINT + 25)) AS k, house FROM t, h WHERE target > 0),
r AS (SELECT pos, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, pos) AS n, house FROM q),
p AS (SELECT t.*, least(3 * source_size, coalesce(c.n, 0) * block)::BIGINT AS quota_words FROM t LEFT JOIN (SELECT pos, count(*) AS n FROM r WHERE n <= house GROUP BY pos) c USING (pos), h),
x AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY substr(md5('7:' || doc_id), 1, 12), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS stream_start FROM d),
y AS (SELECT x.*, source_size, target, quota_words, quota_words // greatest(source_size, 1) AS passes FROM x JOIN p ON p.source IS NOT DISTINCT FROM x.source)
SELECT doc_id, size, source_size, target, (passes * size + greatest(0, least(size, quota_words - passes * source_size - stream_start)))::BIGINT AS taken, quota_words, stream_start FROM y"""

_OP4 = f"""WITH {_URL}, r(h, p, verdict) AS (VALUES {", ".join(str(x) for x in URL_RULES)}),
f AS (SELECT page_id, url, host, path, h || p AS rule, r.verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) AS k
  FROM v LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1"""

_OP5 = rf"""WITH RECURSIVE w AS (SELECT doc_id, coalesce({_WORDS.format(f"translate(text, '{_UPPER}', '{_LOWER}')")}, []) AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]] ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS g FROM w),
n AS (SELECT doc_id, len(g) AS n FROM g), e AS (SELECT doc_id, unnest(g) AS s FROM g),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
u AS (SELECT a, b FROM l UNION SELECT b, a FROM l), t AS (SELECT a AS d, a AS r FROM u UNION SELECT t.d, u.b FROM t JOIN u ON u.a = t.r),
m AS (SELECT d, min(r) AS m FROM t GROUP BY d)
SELECT doc_id, n::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id, coalesce(m, doc_id) = doc_id AS kept FROM n LEFT JOIN m ON d = doc_id"""

_OP6 = """WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS b FROM embeddings),
d AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, 65), lambda i: abs(q.b[i] - c.b[i])))::INT AS distance FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INT AS rank, vec_id, distance FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= 10"""

_OP9 = """WITH x AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS n, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT h, max(page_id) AS k FROM x WHERE n >= 1000 GROUP BY h)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN k IS NULL OR k = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k <> page_id THEN k END AS refers_to FROM x LEFT JOIN k USING (h)"""

_weights = licences.Weights()
_OP10 = rf"""WITH {_URL}, f AS (SELECT page_id, host || path AS path, unnest(string_split(regexp_replace(regexp_replace(html, '<[^>]*>', '
', 'g'), '([.!?:;])\s+', '\1
', 'g'), '
')) AS line FROM v),
l AS (SELECT DISTINCT line FROM f), w AS (SELECT line, unnest(regexp_extract_all(lower(line), '[a-z0-9]+')) AS term FROM l), tf AS (SELECT line, term, count(*) AS n FROM w WHERE term NOT IN {licences.STOP} GROUP BY 1, 2),
i(term, idf) AS (VALUES {", ".join(f"('{t}', {x!r}::DOUBLE)" for t, x in sorted(_weights.idf.items()))}),
tv(template, licence, term, weight) AS (VALUES {", ".join(f"({k}, '{licences.TEMPLATES[k][0]}', '{t}', {x!r}::DOUBLE)" for k, v in enumerate(_weights.vectors) for t, x in sorted(v.items()))}),
o AS (SELECT line, term, n * coalesce(idf, {_weights.unknown!r}::DOUBLE) AS x FROM tf LEFT JOIN i USING (term)), nm AS (SELECT line, sqrt(sum(x * x)) AS norm FROM o GROUP BY 1),
sc AS (SELECT line, licence, template, round(sum(x * weight) / any_value(norm), 9) AS score FROM o JOIN tv USING (term) JOIN nm USING (line) GROUP BY 1, 2, 3),
ow AS (SELECT page_id, licence, score FROM (SELECT page_id, licence, score, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, licence) AS k FROM f JOIN sc USING (line) WHERE score >= .6) WHERE k = 1),
m AS (SELECT page_id, host || path AS path, CASE WHEN contains(host || path, '/') THEN regexp_extract(host || path, '(?s)^(.*/)', 1) ELSE host || path || '/' END AS dir, licence, score FROM v LEFT JOIN ow USING (page_id)),
gr AS (SELECT dir, licence AS granted FROM (SELECT dir, licence, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, licence) AS k FROM m WHERE licence IS NOT NULL GROUP BY dir, licence) WHERE k = 1),
ne AS (SELECT d.dir, arg_max(granted, length(gr.dir)) AS granted, arg_max(gr.dir, length(gr.dir)) AS from_directory FROM (SELECT DISTINCT dir FROM m) d JOIN gr ON starts_with(d.dir, gr.dir) GROUP BY 1)
SELECT page_id, path, coalesce(licence, granted) AS licence, score, CASE WHEN licence IS NOT NULL THEN 'notice' WHEN granted IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
  CASE WHEN licence IS NULL THEN from_directory END AS from_directory FROM m LEFT JOIN ne USING (dir)"""

def _values(rows) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in row) + ")" for row in rows) + ")"


def _sql_terms(text: str) -> str:
    negation = notices.NEGATION.replace("'", "''")
    return f"regexp_extract_all(replace(regexp_replace(translate({text}, '{_UPPER}', '{_LOWER}'), '{negation}', ' not', 'g'), 'licence', 'license'), '{notices.TERM}')"


_END = notices.SENTENCE_END.replace("'", "''")
_OP10_NOTICES = rf"""WITH {_URL}, x AS MATERIALIZED (SELECT page_id, host || path AS path, regexp_replace(html, '<!--|-->|<[^>]*>', chr(10), 'g') AS t FROM v),
nm(licence, name) AS {_values((k, n) for k, v in notices.NAMES.items() for n in v)}, gr(g) AS {_values((g,) for g in notices.GRANTS)}, mn(m) AS {_values((m,) for m in notices.MENTIONS)},
an AS (SELECT name FROM nm UNION ALL SELECT 'License'),
tx AS (SELECT licence, 0 AS title, replace(g, '{{}}', name) AS t FROM nm, gr UNION ALL SELECT '', 0, replace(g, '{{}}', name) || ' not' FROM an, gr UNION ALL SELECT '', 0, replace(m, '{{}}', name) FROM an, mn
  UNION ALL SELECT '', 0, replace(g, '{{}}', 'License') FROM gr UNION ALL SELECT licence, 1, name FROM nm UNION ALL SELECT a, 1, b FROM {_values(notices.TITLES)} y(a, b) UNION ALL SELECT a, 0, b FROM {_values(notices.SENTENCES)} y(a, b)),
tm AS MATERIALIZED (SELECT licence, title, terms, row_number() OVER () AS template FROM (SELECT DISTINCT licence, title, list_sort(list_distinct({_sql_terms("t")})) AS terms FROM tx)),
tt AS MATERIALIZED (SELECT template, licence, title, unnest(terms) AS term FROM tm), vo AS (SELECT DISTINCT term FROM tt), al AS (SELECT list(term) AS known FROM vo), cn AS (SELECT count(*) AS n FROM x),
df AS (SELECT term, count(*) AS d FROM (SELECT unnest(list_distinct({_sql_terms("t")})) AS term FROM x) JOIN vo USING (term) GROUP BY term),
i AS MATERIALIZED (SELECT term, pow(ln((1 + n) / (1 + coalesce(d, 0))) + 1, 2) AS sq FROM vo LEFT JOIN df USING (term), cn),
ts AS (SELECT template, sum(sq) AS tsq FROM tt JOIN i USING (term) GROUP BY template),
pa AS (SELECT page_id, unnest(regexp_split_to_array(regexp_replace(replace(t, chr(13), ''), '{notices.COMMENT}', '', 'g'), '{notices.BLANK}')) AS p FROM x),
se AS (SELECT page_id, {_sql_terms("s")} AS w FROM (SELECT page_id, unnest(string_split(regexp_replace(p, '{_END}', '' || chr(10) || chr(10) || '', 'g'), chr(10) || chr(10))) AS s FROM pa)),
he AS (SELECT page_id, w FROM (SELECT page_id, {_sql_terms("s")} AS w FROM (SELECT page_id, unnest([regexp_extract(p, '^[ 	
]*([^
]*)', 1), regexp_extract(p, '^[ 	
]*([^
]*
[^
]*)', 1)]) AS s FROM pa)) WHERE len(w) <= {notices.TITLE_WORDS}),
sp AS (SELECT page_id, 0 AS title, CASE WHEN len(w) <= {notices.SPAN} THEN w ELSE list_slice(w, b, b + {notices.SPAN - 1}) END AS w
  FROM (SELECT page_id, w, unnest(CASE WHEN len(w) <= {notices.SPAN} THEN [1] ELSE range(1, len(w) - {notices.SPAN // 2 - 1}, {notices.SPAN // 2}) END) AS b FROM se) UNION ALL SELECT page_id, 1, w FROM he),
hd AS MATERIALIZED (SELECT DISTINCT page_id, title, held, CASE WHEN title = 1 THEN len(list_distinct(w)) - len(held) ELSE 0 END AS f FROM (SELECT page_id, title, w, list_sort(list_intersect(w, known)) AS held FROM sp, al) WHERE len(held) > 0),
st AS MATERIALIZED (SELECT row_number() OVER () AS k, title, held, f FROM (SELECT DISTINCT title, held, f FROM hd)),
su AS MATERIALIZED (SELECT k, title, f, unnest(held) AS term FROM st), ss AS (SELECT k, sum(sq) + any_value(f) * pow(ln(1 + any_value(n)) + 1, 2) AS ssq FROM su JOIN i USING (term), cn GROUP BY k),
dt AS (SELECT k, template, any_value(su.title) AS title, any_value(licence) AS licence, sum(sq) AS dot FROM su JOIN i USING (term) JOIN tt ON tt.term = su.term AND tt.title = su.title GROUP BY k, template),
sc AS (SELECT k, licence, max(round(dot / sqrt(tsq * ssq), 9)) AS score FROM dt JOIN ts USING (template) JOIN ss USING (k) WHERE round(dot / sqrt(tsq * ssq), 9) >= CASE WHEN title = 1 THEN {notices.TITLE_THRESHOLD} ELSE {notices.THRESHOLD} END GROUP BY k, licence),
rk AS (SELECT k, licence, score, row_number() OVER w AS r, lead(score) OVER w AS second FROM sc WINDOW w AS (PARTITION BY k ORDER BY score DESC, licence DESC)),
cl AS (SELECT title, held, f, licence, score FROM rk JOIN st USING (k) WHERE r = 1 AND licence <> '' AND (second IS NULL OR round(score - second, 9) >= {notices.MARGIN})),
fl AS (SELECT page_id, licence, max(score) AS score FROM hd JOIN cl USING (title, held, f) GROUP BY ALL),
ow AS (SELECT page_id, licence, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, licence) AS k FROM fl
  WHERE NOT (licence = 'BSD-2-Clause' AND page_id IN (SELECT page_id FROM fl WHERE licence = 'BSD-3-Clause'))) WHERE k = 1),
m AS (SELECT page_id, path, CASE WHEN contains(path, '/') THEN regexp_extract(path, '(?s)^(.*/)', 1) ELSE path || '/' END AS dir, licence, score FROM x LEFT JOIN ow USING (page_id)),
ga AS (SELECT dir, licence AS granted FROM (SELECT dir, licence, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, licence) AS k FROM m WHERE licence IS NOT NULL GROUP BY dir, licence) WHERE k = 1),
ne AS (SELECT d.dir, arg_max(granted, length(ga.dir)) AS granted, arg_max(ga.dir, length(ga.dir)) AS from_directory FROM (SELECT DISTINCT dir FROM m) d JOIN ga ON starts_with(d.dir, ga.dir) GROUP BY 1)
SELECT page_id, path, coalesce(licence, granted) AS licence, score, CASE WHEN licence IS NOT NULL THEN 'notice' WHEN granted IS NOT NULL THEN 'directory' ELSE 'none' END AS origin,
  CASE WHEN licence IS NULL THEN from_directory END AS from_directory FROM m LEFT JOIN ne USING (dir)"""


def _crc_table() -> list[int]:
    """The byte table of CRC-32 (reflected polynomial 0xEDB88320)."""
    def after(value: int) -> int:
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        return value

    return [after(b) for b in range(256)]


_FEATURES = rf"""SELECT {{0}} AS id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f
  FROM (SELECT {{0}}, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM {{1}} WHERE text IS NOT NULL)"""
_OP13 = f"""WITH df AS ({_FEATURES.format("doc_id", "documents")}), bf AS ({_FEATURES.format("item_id", "benchmark")}),
u AS (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)),
c AS (SELECT f, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(f)), '..'), lambda p: ('0x' || p)::BIGINT), lambda a, b: xor(a >> 8, ({_crc_table()}::BIGINT[])[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 10000 AS b FROM u),
dc AS (SELECT id, b, count(*) AS n FROM df JOIN c USING (f) GROUP BY ALL), bc AS (SELECT b, count(*)::DOUBLE AS t FROM bf JOIN c USING (f) GROUP BY b),
sc AS (SELECT b, sum(n)::DOUBLE AS s FROM dc GROUP BY b), tot AS (SELECT (SELECT count(*) FROM df)::DOUBLE AS ss, (SELECT count(*) FROM bf)::DOUBLE AS tt),
g AS (SELECT b, floor(1000 * ln(((coalesce(t, 0) + 1) * (ss + 10000)) / ((s + 1) * (tt + 10000))))::BIGINT AS gain FROM sc LEFT JOIN bc USING (b), tot),
w AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM dc JOIN g USING (b) GROUP BY id),
x AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))))::BIGINT AS score FROM documents LEFT JOIN w ON id = doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS able FROM x WHERE n_features >= 57)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 5 * able // 100 THEN k END AS rank FROM x LEFT JOIN r USING (doc_id)"""

SQL: dict[str, str] = {"op2_source_mix": _OP2, "op4_url_verdicts": _OP4, "op5_near_duplicates": _OP5, "op6_hamming_top_k": _OP6, "op9_warc_archives": _OP9, "op10_license_scan": _OP10, "op10_license_notices": _OP10_NOTICES,
                       "op13_importance_resampling": _OP13}
