"""Registered queries of the dealt operators and their comparison SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .line_dedup import line_dedup
from .maxent_lm import score_texts
from .mixing import mix_sources
from .ngram_join import ngram_components
from .packing import pack_documents
from .personal_data import KINDS, find_personal_data
from .prefix_trie import prefix_trie
from .source_audit import source_divergence
from .substring_dedup import substring_dedup
from .topk_search import topk_inner_product
from .toxicity import toxicity
from .url_filter import filter_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(id_col: str):
    """crc32 of the id as text, modulo 5; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % 5


WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


PLAIN = r"regexp_extract_all({text}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(text=LOWER.format(text="coalesce(text, '')"))


@query(
    "op1_decontamination",
    f"""
    WITH d AS (SELECT doc_id, {PLAIN} AS w FROM documents),
    items AS (SELECT item_id, {PLAIN} AS w FROM benchmark),
    iw AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, least(len(w), 10) AS n,
                  array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
           FROM items, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS r(i) WHERE len(w) > 0),
    dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
           FROM d, (SELECT DISTINCT n FROM iw) AS lengths, unnest(range(1, len(w) - n + 2)) AS r(i)),
    hit AS (SELECT doc_id, i, n, item FROM dw JOIN iw USING (n, k)),
    words AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM (SELECT DISTINCT doc_id, i, n FROM hit), unnest(range(0, n)) AS t(o) GROUP BY doc_id),
    found AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM hit GROUP BY doc_id)
    SELECT doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
           CAST(coalesce(found.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(words.n, 0) > 0 AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
    """,
)
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return out.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op2_substring_dedup",
    f"""
    WITH d AS (SELECT doc_id, {WORDS.format(text="text")} AS w FROM documents),
    win AS (SELECT doc_id, i, sha256(array_to_string(w[i:i + 49], ' ')) AS k
            FROM d, unnest(range(1, len(w) - 48)) AS r(i)),
    firsts AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
    bad AS (SELECT DISTINCT doc_id, i + o AS p FROM win JOIN firsts USING (k), unnest(range(0, 50)) AS t(o)
            WHERE least < doc_id),
    gone AS (SELECT doc_id, count(*) AS n, list(p) AS ps FROM bad GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
           sha256(coalesce(array_to_string(
               CASE WHEN n IS NULL THEN w
                    ELSE list_transform(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(ps, x)), lambda x: w[x]) END,
               ' '), '')) AS kept_sha256
    FROM d LEFT JOIN gone USING (doc_id)
    """,
)
def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"), window=50)
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("doc_id", "n_words", length.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query(
    "op3_ngram_join",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWER.format(text="coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS k
           FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS r(i) WHERE len(w) > 0),
    size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
    link AS (SELECT a, b FROM common JOIN size p ON p.doc_id = a JOIN size q ON q.doc_id = b WHERE 100 * x >= 90 * (p.n + q.n - x)),
    edge AS (SELECT a AS u, b AS v FROM link UNION ALL SELECT b, a FROM link),
    reach AS (SELECT doc_id AS u, doc_id AS v FROM d UNION SELECT reach.u, edge.v FROM reach JOIN edge ON edge.u = reach.v)
    SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id
    FROM d LEFT JOIN size USING (doc_id) JOIN (SELECT u AS doc_id, min(v) AS c FROM reach GROUP BY u) USING (doc_id)
    """,
)
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ngram_components(table(spark, sf_dir, "documents"), shingle=3, percent=90)
    return out.select("doc_id", "n_shingles", "component_id")


@query(
    "op4_line_dedup",
    """
    WITH lines AS (
        SELECT doc_id, source, i, trim(l[i]) AS line
        FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i)
        WHERE trim(l[i]) <> ''),
    spread AS (SELECT line, min(doc_id) AS first_id FROM lines GROUP BY line HAVING count(DISTINCT source) >= 10),
    gone AS (SELECT doc_id, list(i) AS ps FROM lines JOIN spread USING (line) WHERE doc_id > first_id GROUP BY doc_id),
    n AS (SELECT doc_id, count(*) AS n_lines FROM lines GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
           sha256(coalesce(CASE WHEN ps IS NULL THEN text ELSE array_to_string(list_transform(
               list_filter(range(1, len(string_split(text, chr(10))) + 1), lambda i: NOT list_contains(ps, i)),
               lambda i: string_split(text, chr(10))[i]), chr(10)) END, '')) AS kept_sha256
    FROM documents d LEFT JOIN gone USING (doc_id) LEFT JOIN n USING (doc_id)
    """,
)
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"), min_sites=10)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


@query("op5_lm_scoring")
def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), held_out=fold("doc_id") == 1)


@query(
    "op6_mixing",
    """
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
    per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS r FROM d GROUP BY source),
    w AS (SELECT *, [3, 1, 2][r % 3 + 1] AS w, source_size * 2 AS cap FROM per),
    t AS (SELECT *, CAST(cap AS DOUBLE) / w AS ratio, CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS total FROM w),
    b AS (SELECT *, total - coalesce(sum(cap) OVER o, 0)::DOUBLE AS rest, sum(w) OVER () - coalesce(sum(w) OVER o, 0) AS w_left
          FROM t WINDOW o AS (ORDER BY ratio, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    c AS (SELECT *, rest * w >= cap * w_left AS capped FROM b),
    g AS (SELECT *, sum(w) FILTER (NOT capped) OVER () AS open_w, total - coalesce(sum(cap) FILTER (capped) OVER (), 0)::DOUBLE AS open FROM c),
    targets AS (SELECT source, source_size, CASE WHEN capped THEN cap::DOUBLE ELSE open * w / open_w::DOUBLE END AS target FROM g),
    ranked AS (SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY size, md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS k,
                      CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS e
               FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, size, source_size, target,
           CAST(least(floor((k + 1) * e + 0.32383276483316237) - floor(k * e + 0.32383276483316237), 2) AS BIGINT) * size AS taken
    FROM ranked
    """,
)
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, most=2, seed=7)
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id") != 0)
    out = toxicity(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"), "score", "predicted")


@query(
    "op8_topk_search",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS c,
                      row_number() OVER () AS uid
               FROM embeddings
               WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.uid AS quid, q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
          FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.uid <> v.uid AND len(q.c) = len(v.c))
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY quid ORDER BY score DESC, vec_id) AS r FROM s) WHERE r <= 10
    """,
)
def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_inner_product(table(spark, sf_dir, "embeddings"), k=10, every=100, scale=1024)


URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


@query("op9_url_filter")
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = filter_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return out.select("page_id", "host", "path", "rule", "verdict", F.round("trust", 6).alias("trust"), F.round("distrust", 6).alias("distrust"))


@query("op10_personal_data")
def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    counts = [F.expr(f"CAST(size(filter(spans, x -> x.base AND x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


@query(
    "op11_source_audit",
    f"""
    WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all({LOWER.format(text="coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w FROM documents),
    t AS (SELECT rid, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS c FROM t GROUP BY ALL HAVING count(DISTINCT rid) >= 30),
    whole AS (SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang),
    groups AS (SELECT DISTINCT lang, source FROM d),
    cells AS (SELECT lang, source, term, count(*) AS c FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    totals AS (SELECT lang, source, sum(c) AS n FROM cells GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(cells.c, 0) AS c,
                 1 + (1000000000::HUGEINT * (coalesce(cells.c, 0) + 5)) // (coalesce(totals.n, 0) + 5 * v) AS p,
                 1 + (1000000000::HUGEINT * (k.c + 5)) // (whole.n + 5 * v) AS q
          FROM groups g JOIN kept k USING (lang) JOIN whole USING (lang) LEFT JOIN totals USING (lang, source) LEFT JOIN cells USING (lang, source, term)),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b USING (lang, term) GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value
              FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
    rows AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE c > 0 AND p > q)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank
    FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS r FROM rows)
    WHERE part = 'pair' OR r <= 50
    """,
)
def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"), min_df=30, top=50)


@query("op12_packing")
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    out = pack_documents(table(spark, sf_dir, "documents"), tokenizer=path, size=2048, end=1, by_word=True)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query(
    "op13_prefix_trie",
    """
    WITH RECURSIVE turns AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
                   FROM conversations WHERE conv_id IS NOT NULL),
    crc AS (SELECT range::UINTEGER AS byte, 0 AS step, range::UINTEGER AS v FROM range(256)
            UNION ALL SELECT byte, step + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384::UINTEGER) ELSE v >> 1 END FROM crc WHERE step < 8),
    crc_table AS (SELECT list(v ORDER BY byte) AS t FROM crc WHERE step = 8),
    convs AS (SELECT c, n, c - c % 5 AS b,
                     xor(list_reduce(list_prepend(4294967295::UINTEGER, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS UINTEGER))),
                         lambda a, x: xor(a >> 8, t[CAST(xor(a, x) & 255 AS BIGINT) + 1])), 4294967295::UINTEGER) % 9 AS h
              FROM (SELECT c, count(*) AS n FROM turns GROUP BY c), crc_table),
    based AS (SELECT a.c, a.n, a.b, CAST(a.h AS BIGINT) AS h, least(CAST(a.h AS BIGINT), coalesce(b.n, 0)) AS taken FROM convs a LEFT JOIN convs b ON b.c = a.b),
    built AS (SELECT s.c, t.pos, t.role, t.text FROM based s JOIN turns t ON t.c = s.b AND t.pos < s.h
              UNION ALL SELECT s.c, t.pos - s.h + s.taken, t.role, t.text FROM based s JOIN turns t ON t.c = s.c AND t.pos >= s.h),
    prefix AS (SELECT c, 0 AS d, '' AS k, 0 AS bytes FROM based
               UNION ALL
               SELECT p.c, p.d + 1, sha256(p.k || strlen(t.role) || ':' || t.role || t.text), strlen(t.text) FROM prefix p JOIN built t ON t.c = p.c AND t.pos = p.d),
    lens AS (SELECT c, max(d) AS n FROM prefix GROUP BY c),
    node AS (SELECT k, d, min(p.c) AS conv, count(*) AS n, max(bytes) AS bytes, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) FILTER (lens.n = d) AS ends
             FROM prefix p JOIN lens USING (c) GROUP BY k, d),
    up AS (SELECT n.k, n.d, p.k AS pk, p.d AS pd FROM node n JOIN prefix p ON p.c = n.conv AND p.d <= n.d),
    parent AS (SELECT up.k, up.d, q.conv, q.k AS pk, q.d AS pd FROM up JOIN node q ON q.k = up.pk AND q.d = up.pd WHERE up.pd = up.d - 1),
    kids AS (SELECT pk AS k, pd AS d, count(*) AS n FROM parent GROUP BY pk, pd),
    own AS (SELECT n.k, n.d, (n.n - 1) * n.bytes AS saved, CAST(kids.n IS NULL AS BIGINT) AS leaf FROM node n LEFT JOIN kids USING (k, d)),
    tot AS (SELECT up.pk AS k, up.pd AS d, sum(saved) AS saved, sum(leaf) AS leaves FROM up JOIN own USING (k, d) GROUP BY up.pk, up.pd)
    SELECT node.conv AS conv_id, CAST(d AS BIGINT) AS depth, parent.conv AS parent_conv_id, node.n AS n_convs, coalesce(kids.n, 0) AS n_children,
           CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
    FROM node JOIN tot USING (k, d) LEFT JOIN parent USING (k, d) LEFT JOIN kids USING (k, d)
    """,
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))
