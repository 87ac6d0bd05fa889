"""The registered ``opN_*`` queries and their DuckDB oracle SQL.

Each applies its operator to the whole of its table; the digest columns are
derived from the operator's output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..sources.tables import read_table
from . import ann, bpe, collocations, decontaminate, fingerprints, html_text, jaccard_join, merkle, mixing, quality, toxicity, url_filter, warc
from .common import crc_remainder, materialize, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Exponent of the source sizes that op2 and the pipeline mix by.
MIX_EXPONENT = 0.7
#: Documents of a block of the mix.
MIX_BLOCK = 16

# The rules of op7 (verdict, host, path).
URL_RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def vocabulary_path() -> str:
    """Where the public vocabulary file of op4 is installed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return register


@_query("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset fingerprints of every document and of its edited text."""
    return fingerprints.edit_report(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP2_SQL = f"""
WITH RECURSIVE size AS (SELECT CAST(greatest({MIX_BLOCK}, ceil(count(*) / {mixing.MAX_BLOCKS}.0)) AS BIGINT) AS rows FROM documents),
sizes AS (
  SELECT source, pow(CAST(count(*) AS DOUBLE), {MIX_EXPONENT}) AS weight, CAST((count(*) + rows - 1) // rows AS BIGINT) AS blocks
  FROM documents, size GROUP BY source, rows),
lists AS (
  SELECT list(source ORDER BY source NULLS FIRST) AS sources, list(weight ORDER BY source NULLS FIRST) AS weights, list(blocks ORDER BY source NULLS FIRST) AS blocks,
         max(weight) AS top FROM sizes),
parts AS (
  SELECT sources, blocks, [CAST(floor(w / top / total * 1152921504606846976.0) AS HUGEINT) FOR w IN weights] AS parts
  FROM (SELECT *, list_reduce([w / top FOR w IN weights], lambda x, y: x + y) AS total FROM lists)),
one AS (SELECT *, list_reduce(parts, lambda x, y: x + y) AS period FROM parts),
fold AS (
  SELECT CAST(-1 AS HUGEINT) AS slot, CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT) FOR p IN parts] AS done, sources, parts, blocks, period FROM one
  UNION ALL
  SELECT now, due.i, [CASE WHEN j = due.i THEN done[j] + 1 ELSE done[j] END FOR j IN range(1, len(parts) + 1)], sources, parts, blocks, period
  FROM (SELECT *, list_min([{{'d': x.d, 'i': x.i}} FOR x IN ready IF x.r <= now]) AS due
        FROM (SELECT *, greatest(slot + 1, list_min([x.r FOR x IN ready])) AS now
              FROM (SELECT *, [{{'r': done[j] * period // parts[j], 'd': ((done[j] + 1) * period + parts[j] - 1) // parts[j], 'i': j}}
                               FOR j IN range(1, len(parts) + 1) IF done[j] < blocks[j]] AS ready FROM fold)
              WHERE len(ready) > 0))),
plan AS (
  SELECT sources[i] AS source, done[i] - 1 AS block, CAST(slot AS BIGINT) AS slot, CAST((done[i] - 1) * period // parts[i] AS BIGINT) AS release,
         CAST((done[i] * period + parts[i] - 1) // parts[i] AS BIGINT) AS deadline
  FROM fold WHERE slot >= 0),
docs AS (
  SELECT doc_id, source, nr // rows AS block, nr % rows AS place
  FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST) - 1 AS nr FROM documents), size)
SELECT d.doc_id, d.source, CAST(d.block AS BIGINT) AS block, CAST(d.place AS INTEGER) AS place, p.slot, p.release, p.deadline
FROM docs d LEFT JOIN plan p ON p.source IS NOT DISTINCT FROM d.source AND p.block = d.block
"""


@_query("op2_mixing", OP2_SQL)
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every document in a mix of the sources."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.mix(docs, mixing.temperature_weights(docs, MIX_EXPONENT), block_rows=MIX_BLOCK)


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
                                    ELSE [array_to_string(w[i : i + 3], ' ') FOR i IN range(1, len(w) - 2)] END) AS s
  FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM members a JOIN members b ON a.g = b.g AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sets
  UNION
  SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id
FROM sets s JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) m ON m.x = s.doc_id
"""


@_query("op3_jaccard_join", OP3_SQL)
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 4-word shingle sets overlap by 85 %."""
    return jaccard_join.jaccard_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"), words=4, percent=85)


@_query("op4_bpe")
def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return bpe.digests(read_table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path())


@_query("op5_html_text")
def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = html_text.extract_text(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@_query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document; rows with remainder 2 are held out."""
    held_out = crc_remainder(F.col("doc_id"), 4) == 2
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, read_table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.score(docs, lexicon).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


OP7_SQL = """
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw_host FROM parts),
urls AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path FROM hosts),
rules(verdict, h, p) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits AS (
  SELECT u.page_id, r.h || r.p AS rule, r.verdict, row_number() OVER (PARTITION BY u.page_id ORDER BY length(r.h || r.p) DESC, r.verdict) AS k
  FROM urls u JOIN rules r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p))
SELECT u.page_id, u.host, u.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM urls u LEFT JOIN fits f ON f.page_id = u.page_id AND f.k = 1
"""


@_query("op7_url_filter", OP7_SQL)
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the url of every page."""
    return url_filter.judge(read_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@_query("op8_nearest_neighbours")
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest vectors of every 50th, by cosine."""
    rows = materialize(ann.valid_vectors(read_table(spark, sf_dir, "embeddings")), "ann-vectors")
    index = ann.build(rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return ann.search(index, rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)


OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to
FROM g
"""


@_query("op9_warc", OP9_SQL)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all pages, written as WARC archives and read back."""
    manifest = warc.write(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return warc.read(manifest, payloads=False).drop("url")


@_query("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; rows with remainder 0 are held out."""
    held_out = crc_remainder(F.col("doc_id"), 5) == 0
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.trusted_positives(read_table(spark, sf_dir, "labels"), held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM words, range(1, 6) t(m) WHERE len(w) >= m)),
f AS (SELECT lang, m, phrase, CAST(count(*) AS HUGEINT) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100),
parts AS (SELECT lang, m, phrase, a, string_split(phrase, ' ') AS w FROM f),
cuts AS (
  SELECT lang, m, phrase, a, k, array_to_string(w[1 : k], ' ') AS x, array_to_string(w[k + 1 : m], ' ') AS y
  FROM (SELECT *, unnest(range(1, m)) AS k FROM parts WHERE m >= 2)),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, t.n, 1000 * c.a * t.n // (l.a * r.a) AS score, c.k
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.m = c.k AND l.phrase = c.x JOIN f r ON r.lang = c.lang AND r.m = c.m - c.k AND r.phrase = c.y JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY 1000 * c.a * t.n // (l.a * r.a), c.k) = 1),
inner_parts AS (
  SELECT lang, a, array_to_string(w[i : i + j - 1], ' ') AS phrase
  FROM (SELECT lang, a, w, j, unnest(range(1, m - j + 2)) AS i FROM parts, range(2, 5) t(j) WHERE j < m)),
covered AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY lang, phrase),
kept AS (SELECT s.* FROM scored s LEFT JOIN covered c ON c.lang = s.lang AND c.phrase = s.phrase WHERE c.most IS NULL OR 100 * c.most < 100 * s.a)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r,
       CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
"""


@_query("op11_collocations", OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of each language."""
    return collocations.collocations(read_table(spark, sf_dir, "documents").select("lang", "text"), min_count=100, longest=5, top=2000)


OP12_SQL = """
WITH RECURSIVE lower AS (
  SELECT *, CASE WHEN crc % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS now
  FROM (SELECT *, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || [CAST(ascii(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')],
                 lambda acc, b: list_reduce([xor(acc, b)] || [CAST(0 AS BIGINT) FOR i IN range(8)], lambda x, z: xor(x >> 1, 3988292384 * (x & 1))))) AS crc
        FROM documents)),
parts AS (
  SELECT doc_id, source,
         array_to_string([CASE WHEN v IS NULL THEN '-' ELSE strlen(v) || ':' || v END FOR v IN [CAST(doc_id AS VARCHAR), source, lang, CAST(n_chars AS VARCHAR)]], '') AS head,
         CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS old, CASE WHEN now IS NULL THEN '-' ELSE strlen(now) || ':' || now END AS new
  FROM lower),
leaves AS (
  SELECT doc_id, source, sha256(head || old) AS leaf, sha256(head || new) AS now,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM parts),
nodes AS (
  SELECT 0 AS level, source, i, leaf AS digest, n FROM leaves
  UNION ALL
  SELECT max(level) + 1, source, i // 16, sha256(string_agg(digest, '' ORDER BY i)), max((n + 15) // 16) FROM nodes WHERE n > 1 GROUP BY source, i // 16),
tops AS (
  SELECT source, digest, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
top_nodes AS (
  SELECT 0 AS level, i, digest, n FROM tops
  UNION ALL
  SELECT max(level) + 1, i // 16, sha256(string_agg(digest, '' ORDER BY i)), max((n + 15) // 16) FROM top_nodes WHERE n > 1 GROUP BY i // 16),
sides AS (
  SELECT a.source, a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM nodes a JOIN nodes b ON a.source IS NOT DISTINCT FROM b.source AND a.level = b.level AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY ALL),
top_sides AS (
  SELECT a.level, a.i, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r
  FROM top_nodes a JOIN top_nodes b ON a.level = b.level AND a.i // 16 = b.i // 16 WHERE a.n > 1 GROUP BY ALL),
climb AS (
  SELECT doc_id, source, leaf, 0 AS level, i, now AS digest, '' AS proof, false AS top FROM leaves
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, CASE WHEN s.l IS NULL AND NOT c.top THEN 0 ELSE c.level + 1 END, CASE WHEN c.top OR s.l IS NOT NULL THEN c.i // 16 ELSE t.i END,
         CASE WHEN c.top THEN sha256(u.l || c.digest || u.r) WHEN s.l IS NULL THEN c.digest ELSE sha256(s.l || c.digest || s.r) END,
         CASE WHEN c.top THEN c.proof || u.l || u.r WHEN s.l IS NULL THEN c.proof ELSE c.proof || s.l || s.r END, c.top OR s.l IS NULL
  FROM climb c LEFT JOIN sides s ON NOT c.top AND s.source IS NOT DISTINCT FROM c.source AND s.level = c.level AND s.i = c.i
  LEFT JOIN tops t ON t.source IS NOT DISTINCT FROM c.source LEFT JOIN top_sides u ON c.top AND u.level = c.level AND u.i = c.i
  WHERE NOT c.top OR u.l IS NOT NULL),
done AS (SELECT * FROM climb WHERE top QUALIFY row_number() OVER (PARTITION BY doc_id, source ORDER BY level DESC) = 1)
SELECT d.doc_id, d.leaf, t.digest AS subroot, r.digest AS root, sha256(d.proof) AS proof_sha256, d.digest AS folded_root, d.digest = r.digest AS verified
FROM done d JOIN tops t ON t.source IS NOT DISTINCT FROM d.source, (SELECT digest FROM top_nodes WHERE n = 1) r
"""


@_query("op12_merkle_manifest", OP12_SQL)
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle proofs of every document, checked against a copy in which a fifth of the texts are lower-cased."""
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    proofs = merkle.check(read_table(spark, sf_dir, "documents").select(*columns), columns, "doc_id", "source", crc_remainder(F.col("doc_id"), 5) == 0, {"text": lowered})
    return proofs.withColumnRenamed("id", "doc_id")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT doc_id, i, k, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) WHERE len(w) >= k)),
found AS (SELECT p.doc_id, p.i, p.k, x.item_id FROM places p JOIN windows x ON x.k = p.k AND x.g = p.g),
hits AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, CAST(coalesce(len(t.ids), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(t.ids, ','), '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN items t ON t.doc_id = d.doc_id
"""


@_query("op13_decontaminate", OP13_SQL)
def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in passages of the benchmark."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find(docs, read_table(spark, sf_dir, "benchmark"), drop_text=True)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
