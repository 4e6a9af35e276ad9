"""The registered queries of the corpus operators, each over its whole table, and their SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filigrane.llm import copies, decontaminate, forest, language, licences, lines, middle, mixing, pii, repeats, search, secret_scan, shards
from filigrane.llm.common import digest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def counted(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long")


def joined(spans: F.Column) -> F.Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


@query("op3_line_dedup", r"""
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
one AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM cut),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM one),
rep AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
judged AS (SELECT doc_id, line, i, coalesce(rep.last <> doc_id, false) AS gone FROM keyed LEFT JOIN rep USING (k))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id""")
def op3(spark, sf):
    out = lines.dedup_lines(documents(spark, sf))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)""")
def op6(spark, sf):
    return copies.exact_groups(documents(spark, sf))


@query("op10_pii")
def op10(spark, sf):
    out = pii.find_pii(documents(spark, sf))
    inside = F.filter("spans", lambda s: s.kind.isin(*pii.BASE_KINDS))
    return out.select("doc_id", *[counted(k).alias(f"n_{k}") for k in pii.BASE_KINDS],
                      F.sha2(joined(inside), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
                      F.transform("spans", lambda s: s.score).alias("scores"))


#: Target weights of the registered mixture: domains (the source's number by 4) and languages; sources weigh the same.
DOMAIN_WEIGHTS = {"d0": 4, "d1": 3, "d2": 2}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2}


def domain(source: str = "source") -> F.Column:
    return F.concat(F.lit("d"), F.expr(f"try_cast(regexp_extract({source}, '[0-9]+$', 0) as bigint) % 4"))


def by_value(name: str, table: dict[str, int], other: int = 1) -> F.Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(F.col(name) == k, v).otherwise(out)
    return out


def mixture(docs: DataFrame, budget: F.Column) -> DataFrame:
    return mixing.mix(docs, [("domain", domain()), ("lang", F.col("lang")), ("source", F.col("source"))],
                      [by_value("domain", DOMAIN_WEIGHTS), by_value("lang", LANG_WEIGHTS), F.lit(1)], budget)


def _fill_sql(name: str, nodes: str, parents: str) -> str:
    """One level of the sharing out: all children whose capacity is below their share are full."""
    part = f"PARTITION BY {parents}" if parents else ""
    return f"""{name}_r AS (SELECT *, coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS c0,
      (sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::HUGEINT AS w0
    FROM {nodes} WINDOW w AS ({part} ORDER BY cap / weight, child)),
{name}_f AS (SELECT *, cap::HUGEINT * w0 <= (budget - c0) * weight AS isfull FROM {name}_r),
{name} AS (SELECT *, CASE WHEN isfull THEN cap ELSE ((budget - coalesce(sum(cap) FILTER (isfull) OVER ({part}), 0))::HUGEINT * weight
      // sum(weight) FILTER (NOT isfull) OVER ({part}))::BIGINT END AS alloc FROM {name}_f)"""


def _case(name: str, table: dict[str, int]) -> str:
    return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in table.items()) + " ELSE 1 END"


MIX_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('d' || (TRY_CAST(regexp_extract(source, '[0-9]+$') AS BIGINT) % 4), '') AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS size, 2 * sum(tokens)::BIGINT AS cap FROM d GROUP BY ALL),
n1 AS (SELECT domain, domain AS child, sum(cap)::BIGINT AS cap, {_case("domain", DOMAIN_WEIGHTS)} AS weight,
    (SELECT least(sum(size) * 3 // 4, sum(cap))::BIGINT FROM leaf) AS budget FROM leaf GROUP BY ALL HAVING sum(cap) > 0),
{_fill_sql("a1", "n1", "")},
n2 AS (SELECT l.domain, l.lang, l.lang AS child, sum(l.cap)::BIGINT AS cap, {_case("l.lang", LANG_WEIGHTS)} AS weight, a1.alloc AS budget
    FROM leaf l JOIN a1 USING (domain) GROUP BY ALL HAVING sum(l.cap) > 0),
{_fill_sql("a2", "n2", "domain")},
n3 AS (SELECT l.domain, l.lang, l.source, l.source AS child, l.size, l.cap, 1 AS weight, a2.alloc AS budget
    FROM leaf l JOIN a2 USING (domain, lang) WHERE l.cap > 0),
{_fill_sql("a3", "n3", "domain, lang")},
plan AS (SELECT domain, lang, source, alloc // size AS whole, alloc % size AS rest FROM a3),
placed AS (SELECT d.*, whole, rest, md5('7|' || whole || '|' || doc_id) AS place FROM d JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY place) - tokens AS before FROM placed),
kept AS (SELECT *, unnest(range(whole + CASE WHEN before < rest THEN 1 ELSE 0 END)) AS epoch FROM summed)
SELECT doc_id, domain, lang, source, epoch, tokens, CASE WHEN epoch = whole THEN least(tokens, rest - before)::BIGINT ELSE tokens END AS take
FROM kept"""


@query("op8_mixing", MIX_SQL)
def op8(spark, sf):
    docs = documents(spark, sf).select("doc_id", "text", F.col("lang"), F.col("source"))
    out = mixture(docs, F.expr("total * 3 div 4"))
    return out.select("doc_id", "_mix.domain", "_mix.lang", "_mix.source", "_mix.epoch", "_mix.tokens", "_mix.take")


SHARDS = 24


def sharding(docs: DataFrame) -> DataFrame:
    """Documents lie in a space of source, language, length and id."""
    return shards.shard(docs, [("source", shards.hashed(F.col("source"))), ("lang", shards.hashed(F.col("lang"))),
                               ("length", shards.magnitude(F.length("text"))), ("id", shards.hashed(F.coalesce(F.col("doc_id").cast("string"), digest())))], SHARDS)


@query("op9_sharding")
def op9(spark, sf):
    out = sharding(documents(spark, sf))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def held_out(docs: DataFrame) -> F.Column:
    return F.coalesce(F.crc32(docs["doc_id"].cast("string").cast("binary")) % 4 == 2, F.lit(False)).alias("held_out")


@query("op2_language_id")
def op2(spark, sf):
    docs = documents(spark, sf)
    model = language.learn(docs.where(~held_out(docs)))
    out = language.identify(docs, model)
    return out.select("doc_id", held_out(out), "lang_pred", "score")


@query("op7_decontamination")
def op7(spark, sf):
    return decontaminate.judge(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


@query("op1_jaccard_join", r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
c AS (SELECT ws, min(doc_id) AS id FROM w WHERE len(ws) > 0 GROUP BY ws),
s AS (SELECT id, unnest(list_distinct(list_transform(range(greatest(len(ws) - 4, 1)), lambda i: array_to_string(ws[i + 1:i + 5], ' ')))) AS g
  FROM c),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.id <> b.id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE k >= 0.8 * (x.n + y.n - k) - 1e-6),
reach AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM reach r JOIN l ON l.a = r.b),
k AS (SELECT a, least(a, min(b)) AS class FROM reach GROUP BY a),
m AS (SELECT a, count(*) AS links FROM l GROUP BY a)
SELECT doc_id, coalesce(id, doc_id) AS copy_of, coalesce(class, id, doc_id) AS class_id, coalesce(links, 0) AS n_links
FROM w LEFT JOIN c ON c.ws = w.ws LEFT JOIN k ON k.a = c.id LEFT JOIN m ON m.a = c.id""")
def op1(spark, sf):
    return forest.near_duplicates(documents(spark, sf))


@query("op4_secret_scan")
def op4(spark, sf):
    docs = documents(spark, sf)
    out = secret_scan.find_secrets(docs, secret_scan.learn(docs))
    inside = F.filter("spans", lambda s: s.kind != "tagged")
    return out.select("doc_id", *[counted(k).alias(f"n_{k}") for k in secret_scan.KINDS],
                      F.sha2(joined(inside), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


@query("op5_suffix_dedup")
def op5(spark, sf):
    out = repeats.dedup_substrings(documents(spark, sf))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_fill_in_middle", r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls,
             list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS r FROM t),
c AS (SELECT doc_id, t, ls, len(ls) AS n, r[1] % (len(ls) + 1) AS x, r[2] % (len(ls) + 1) AS y,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 THEN 'plain'
                  WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(ls[1:least(x, y)], '') AS pre,
             array_to_string(ls[least(x, y) + 1:greatest(x, y)], '') AS mid, array_to_string(ls[greatest(x, y) + 1:], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p""")
def op11(spark, sf):
    out = middle.fill_in_middle(documents(spark, sf))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(middle.restored("output", "form"), 256).alias("restored_sha256"))


@query("op12_ranked_search", r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
p AS (SELECT r, doc_id, w, count(*) AS tf FROM (SELECT r, doc_id, unnest(ws) AS w FROM d) GROUP BY ALL),
l AS (SELECT r, sum(tf)::BIGINT AS n FROM p GROUP BY r),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM l),
f AS (SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight FROM p, c GROUP BY w, docs),
i AS (SELECT DISTINCT k, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM (SELECT row_number() OVER () AS k, * FROM benchmark)),
s AS (SELECT k, item_id, r, doc_id,
             sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score
      FROM i JOIN f USING (w) JOIN p USING (w) JOIN l USING (r), c GROUP BY k, item_id, r, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10""")
def op12(spark, sf):
    return search.rank_documents(spark.read.parquet(f"{sf}/benchmark.parquet"), documents(spark, sf))


@query("op13_license_scan")
def op13(spark, sf):
    out = licences.scan_licences(documents(spark, sf))
    labels = lambda c: F.transform(c, lambda x: x.label)
    base_labels = labels(F.col("places"))
    best = F.array_max(F.concat(F.transform("matches", lambda m: m.score),
                                F.transform("places", lambda _: F.lit(licences.PHRASE_SCORE)), F.array(F.lit(0.0))))
    return out.select("doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
                      F.array_min(F.transform("places", lambda p: p.start)).alias("first_word"),
                      F.array_max(F.transform("places", lambda p: p.start)).alias("last_word"),
                      F.array_join(F.array_sort(F.array_distinct(base_labels)), ",").alias("base_labels"),
                      F.array_join(F.array_sort(F.array_distinct(F.concat(base_labels, labels(F.col("matches"))))), ",").alias("labels"),
                      best.alias("score"), "matches")
