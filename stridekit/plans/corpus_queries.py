"""Registered corpus queries over ``documents`` (and ``labels``, ``benchmark``),
each next to its independent DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import keywords as KW
from ..functions import text as T
from ..operators import automaton as AU
from ..operators import corpus as C
from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table
from . import params as P
from . import sql_text as S
from .registry import register

CLASSES = KW.CLASS_ORDER


def docs(spark, sf):
    return read_table(spark, sf, "documents").select(
        "doc_id", T.nz("text").alias("text"), "lang", "source", "n_chars"
    )


def classified(spark, sf):
    """Documents as (user, assistant) rows with their keyword class (GENERIC if none)."""
    d = docs(spark, sf)
    d = C.classify(d, F.col("text"), P.DEMO_KEYWORDS).withColumn("class", F.coalesce("best_class", F.lit("GENERIC")))
    return d.select("doc_id", "source", "lang", "text", F.col("text").alias("user"), F.col("text").alias("assistant"), "class")


def _classified_sql() -> str:
    cols = S.class_score_cols("text", P.DEMO_KEYWORDS)
    return f"""cd AS (
      SELECT doc_id, source, lang, coalesce(text, '') AS text, coalesce(text, '') AS "user", coalesce(text, '') AS assistant,
             coalesce({S.best_class(cols)}, 'GENERIC') AS class
      FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents)
    )"""


# ------------------------------------------------------------------- sources

@register("corpus_manifest", "SELECT source, count(*) AS n_rows FROM documents GROUP BY source")
def q_manifest(spark, sf):
    return C.manifest(docs(spark, sf))


# ------------------------------------------------------------------ cleaning

# Every second text in typographic dress: quotes, dashes, an ellipsis, runs of spaces.
_DRESSED_SQL = """CASE WHEN doc_id % 2 = 0 THEN '“' || replace(replace(text, ', ', ' —  '), ' the ', ' ‘the’ ') || '…”' ELSE text END"""


@register("corpus_clean_text", f"SELECT doc_id, {S.clean_text('x')} AS clean FROM (SELECT doc_id, {_DRESSED_SQL} AS x FROM documents)")
def q_clean_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.expr(_DRESSED_SQL).alias("x")).select("doc_id", T.clean_text("x").alias("clean"))


# Texts as posts: deleted ones, quoted lines, emphasis, entities, links, many blank lines.
_POST_SQL = """CASE doc_id % 5 WHEN 0 THEN ' [deleted] '
      WHEN 1 THEN '&gt; ' || text || chr(10) || 'reply'
      WHEN 2 THEN '**' || source || '** &amp; see http://x.y/' || CAST(doc_id AS STRING) || ' ' || text || chr(10) || chr(10) || chr(10) || chr(10) || 'end'
      WHEN 3 THEN '&lt;b&gt; &quot;' || text || '&quot; it&#39;s *so* &Eacute;t&nbsp;&notit; &#x1F600;' ELSE text END"""


@register("corpus_clean_post", f"SELECT doc_id, {S.clean_post('x')} AS clean FROM (SELECT doc_id, {_POST_SQL} AS x FROM documents)")
def q_clean_post(spark, sf):
    return docs(spark, sf).select("doc_id", F.expr(_POST_SQL).alias("x")).select("doc_id", T.clean_post("x").alias("clean"))


@register(
    "corpus_text_cuts",
    f"""SELECT doc_id, {S.cut_at_word('text', 800)} AS cut800, substr(coalesce(text, ''), 1, 400) AS prefix400,
               {S.strip_quotes('text')} AS unquoted,
               regexp_replace(coalesce(source, ''), '[^\\p{{L}}\\p{{N}}_-]', '', 'g') AS source_key
        FROM documents""",
)
def q_text_cuts(spark, sf):
    return docs(spark, sf).select(
        "doc_id", T.cut_at_word("text", 800).alias("cut800"), T.prefix("text", 400).alias("prefix400"),
        T.strip_quotes("text").alias("unquoted"), T.sanitize_key("source").alias("source_key"),
    )


# ------------------------------------------------------------ classification

def _scores_sql():
    cols = S.class_score_cols("text", P.DEMO_KEYWORDS)
    sel = ", ".join(f"{v} AS score_{k}" for k, v in cols.items())
    return f"SELECT doc_id, {sel}, {S.best_class(cols)} AS best_class FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)"


@register("corpus_keyword_classes", _scores_sql())
def q_keyword_classes(spark, sf):
    d = C.classify(docs(spark, sf), F.col("text"), P.DEMO_KEYWORDS)
    return d.select("doc_id", *[f"score_{c}" for c in CLASSES], "best_class")


# A table by rule: the words that stand in most documents, dealt over the classes; the first half weighs 3.
_TABLE_SIZE = 308
_TABLE_SQL = f"""
    w AS (SELECT word, count(*) AS n FROM (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]{{3,}}'))) AS word FROM documents) GROUP BY word),
    r AS (SELECT word AS keyword, row_number() OVER (ORDER BY n DESC, word) - 1 AS r FROM w QUALIFY r < {_TABLE_SIZE}),
    kw AS (SELECT keyword, ([{", ".join(S.q(c) for c in CLASSES)}])[CAST(r % {len(CLASSES)} AS INTEGER) + 1] AS class, CASE WHEN r < {_TABLE_SIZE // 2} THEN 3 ELSE 1 END AS weight FROM r)"""


def keyword_rows(spark, sf):
    words = docs(spark, sf).select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})")))).alias("keyword"))
    top = words.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "keyword").limit(_TABLE_SIZE)
    ranked = top.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "keyword")) - 1)  # over the table's rows
    return ranked.select(
        F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("r") % len(CLASSES) + 1).alias("class"),
        F.when(F.col("r") < _TABLE_SIZE // 2, 3).otherwise(1).alias("weight"), "keyword",
    )


@register("corpus_keyword_table", f"""
    WITH {_TABLE_SQL},
    s AS (SELECT d.doc_id, {", ".join(f"CAST(coalesce(sum(weight) FILTER (WHERE class = '{c}'), 0) AS INTEGER) AS score_{c}" for c in CLASSES)}
          FROM documents d LEFT JOIN kw ON contains(lower(coalesce(d.text, '')), kw.keyword) GROUP BY d.doc_id)
    SELECT *, {S.best_class({c: f"score_{c}" for c in CLASSES})} AS best_class FROM s""")
def q_keyword_table(spark, sf):
    """D1/D2 with a table of 308 keywords, found in one pass of each text."""
    table = AU.keyword_table(keyword_rows(spark, sf))
    return AU.classify(docs(spark, sf), F.col("text"), table).select("doc_id", *[f"score_{c}" for c in CLASSES], "best_class")


@register("corpus_keyword_table_filter", f"""
    WITH {_TABLE_SQL},
    t AS (SELECT doc_id, source, unnest(string_split_regex(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}_]+')) AS word FROM documents)
    SELECT DISTINCT doc_id, source FROM t JOIN kw ON kw.keyword = t.word WHERE weight = 1""")
def q_keyword_table_filter(spark, sf):
    """B19 by whole words: documents with any of the table's lighter keywords."""
    words = [k for _, w, k in AU.keyword_table(keyword_rows(spark, sf)) if w == 1]
    return docs(spark, sf).where(AU.any_present(F.col("text"), words, "word")).select("doc_id", "source")


@register(
    "corpus_keyword_filter",
    f"SELECT doc_id, source FROM documents WHERE {S.any_present('lower(coalesce(text, \'\'))', P.FILTER_KEYWORDS)}",
)
def q_keyword_filter(spark, sf):
    return docs(spark, sf).where(KW.any_present(F.lower("text"), P.FILTER_KEYWORDS)).select("doc_id", "source")


def _source_class_sql():
    vals = ", ".join(f"({S.q(k)}, {S.q(v)})" for k, v in P.SOURCE_CLASS.items())
    return f"""SELECT d.doc_id, d.source, m.class FROM documents d
               JOIN (SELECT * FROM (VALUES {vals}) t(source, class)) m ON m.source = d.source"""


@register("corpus_source_classes", _source_class_sql())
def q_source_classes(spark, sf):
    """Source -> class dimension (broadcast: one row per known source); unmapped dropped."""
    dim = spark.createDataFrame(list(P.SOURCE_CLASS.items()), "source string, class string")
    return docs(spark, sf).join(F.broadcast(dim), "source").select("doc_id", "source", "class")


@register(
    "corpus_first_n_per_source",
    """SELECT doc_id, source FROM (
         SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
         FROM documents WHERE length(coalesce(text, '')) > 100) WHERE rn <= 10""",
)
def q_first_n_per_source(spark, sf):
    d = docs(spark, sf).where(F.length("text") > 100)
    return C.first_n_per_group(d, ["source"], ["doc_id"], 10).select("doc_id", "source")


@register("corpus_validate", f"""
    SELECT doc_id,
           array_to_string(list_filter([
             CASE WHEN NOT ({S.py_strip("coalesce(text, '')")} <> '') THEN 'text_empty' END,
             CASE WHEN NOT (length(coalesce(text, '')) <= 2000) THEN 'text_too_long' END,
             CASE WHEN NOT (coalesce(lang IN ('en', 'fr', 'de', 'es'), false)) THEN 'lang_unknown' END,
             CASE WHEN NOT (length(coalesce(source, '')) BETWEEN 3 AND 32) THEN 'source_length' END
           ], lambda x: x IS NOT NULL), ',') AS reasons,
           len(list_filter([
             CASE WHEN NOT ({S.py_strip("coalesce(text, '')")} <> '') THEN 'text_empty' END,
             CASE WHEN NOT (length(coalesce(text, '')) <= 2000) THEN 'text_too_long' END,
             CASE WHEN NOT (coalesce(lang IN ('en', 'fr', 'de', 'es'), false)) THEN 'lang_unknown' END,
             CASE WHEN NOT (length(coalesce(source, '')) BETWEEN 3 AND 32) THEN 'source_length' END
           ], lambda x: x IS NOT NULL)) = 0 AS is_valid
    FROM documents""")
def q_validate(spark, sf):
    d = docs(spark, sf)
    checks = {
        "text_empty": T.py_strip("text") != "",
        "text_too_long": F.length("text") <= 2000,
        "lang_unknown": F.col("lang").isin("en", "fr", "de", "es"),
        "source_length": F.length(T.nz("source")).between(3, 32),
    }
    v = C.validate_rows(d, checks)
    return v.select("doc_id", F.array_join("reasons", ",").alias("reasons"), "is_valid")


# -------------------------------------------------------------------- dedup

@register("corpus_dedup_first_wins", f"""
    WITH {_classified_sql()}
    SELECT doc_id, class FROM (
      SELECT doc_id, class, row_number() OVER (PARTITION BY class, substr("user", 1, 100) ORDER BY source, doc_id) AS rn
      FROM cd WHERE "user" <> '' AND assistant <> '') WHERE rn = 1""")
def q_dedup_first_wins(spark, sf):
    d = classified(spark, sf).where((F.col("user") != "") & (F.col("assistant") != ""))
    # carry only the key prefix through the shuffle, not the texts
    d = d.select("doc_id", "class", "source", F.substring("user", 1, 100).alias("_k100"))
    return C.dedup_first_wins(d, ["class"], F.col("_k100"), ["source", "doc_id"]).select("doc_id", "class")


@register("corpus_incremental_dedup", """
    SELECT d.doc_id FROM documents d
    WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)
      AND substr(coalesce(d.text, ''), 1, 120) NOT IN (
        SELECT substr(coalesce(x.text, ''), 1, 120) FROM documents x JOIN labels l ON l.doc_id = x.doc_id)""")
def q_incremental_dedup(spark, sf):
    d = docs(spark, sf)
    lab = read_table(spark, sf, "labels").select("doc_id")
    existing = d.join(lab, "doc_id", "left_semi")
    new = d.join(lab, "doc_id", "left_anti")
    return C.incremental_dedup(new, existing, F.substring("text", 1, 120), F.substring("text", 1, 120)).select("doc_id")


@register("corpus_ordered_union", """
    SELECT doc_id, source FROM (
      SELECT doc_id, source, row_number() OVER (PARTITION BY substr(coalesce(text, ''), 1, 120) ORDER BY source, doc_id) AS rn
      FROM documents) WHERE rn = 1""")
def q_ordered_union(spark, sf):
    d = docs(spark, sf).select("doc_id", "source", F.substring("text", 1, 120).alias("_k120"))
    return C.ordered_union(d, "source", F.col("_k120"), ["doc_id"]).select("doc_id", "source")


@register("corpus_key_union", """
    SELECT DISTINCT key FROM (
      SELECT substr(coalesce(d.text, ''), 1, 120) AS key FROM documents d JOIN labels l ON l.doc_id = d.doc_id
      UNION ALL SELECT substr(coalesce(text, ''), 1, 120) FROM benchmark)""")
def q_key_union(spark, sf):
    d = docs(spark, sf).join(read_table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    b = read_table(spark, sf, "benchmark")
    return C.key_set_union(d, b, F.substring(T.nz("text"), 1, 120), F.substring(T.nz("text"), 1, 120))


# ------------------------------------------------------------ quotas, caps

@register("corpus_quota", f"""
    WITH {_classified_sql()}
    SELECT doc_id, source, class FROM (
      SELECT doc_id, source, class, row_number() OVER (PARTITION BY source, class ORDER BY doc_id) AS rn FROM cd)
    WHERE rn <= 20""")
def q_quota(spark, sf):
    return C.quota(classified(spark, sf), ["source", "class"], ["doc_id"], 20).select("doc_id", "source", "class")


@register("corpus_class_cap", f"""
    WITH {_classified_sql()}
    SELECT doc_id, class FROM (
      SELECT doc_id, class, row_number() OVER (PARTITION BY class ORDER BY {S.shuffle_key(P.SEED, 'doc_id')}, doc_id) AS rn FROM cd)
    WHERE rn <= 50""")
def q_class_cap(spark, sf):
    return C.class_cap(classified(spark, sf), "class", "doc_id", 50, P.SEED).select("doc_id", "class")


@register("corpus_cascade", f"""
    WITH RECURSIVE base AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
    s1 AS (SELECT doc_id, '{P.CASCADE_STAGES[0][0]}' AS class FROM (
             SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM base WHERE {S.any_present('t', P.CASCADE_STAGES[0][1])})
           WHERE rn <= {P.CASCADE_STAGES[0][2]}),
    s2 AS (SELECT doc_id, '{P.CASCADE_STAGES[1][0]}' AS class FROM (
             SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM base
             WHERE {S.any_present('t', P.CASCADE_STAGES[1][1])} AND doc_id NOT IN (SELECT doc_id FROM s1))
           WHERE rn <= {P.CASCADE_STAGES[1][2]}),
    s3 AS (SELECT doc_id, '{P.CASCADE_STAGES[2][0]}' AS class FROM (
             SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM base
             WHERE {S.any_present('t', P.CASCADE_STAGES[2][1])} AND doc_id NOT IN (SELECT doc_id FROM s1) AND doc_id NOT IN (SELECT doc_id FROM s2))
           WHERE rn <= {P.CASCADE_STAGES[2][2]})
    SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3""")
def q_cascade(spark, sf):
    d = docs(spark, sf).select("doc_id", "text")
    return C.cascade(d, F.col("text"), P.CASCADE_STAGES, ["doc_id"]).select("doc_id", "class")


# -------------------------------------------------------------------- splits

@register("corpus_split_per_class", f"""
    WITH {_classified_sql()}
    SELECT doc_id, class, CASE WHEN rn <= greatest(1, floor(n * 0.9)) THEN 'train' ELSE 'val' END AS split FROM (
      SELECT doc_id, class, row_number() OVER (PARTITION BY class ORDER BY {S.shuffle_key(P.SEED, 'doc_id')}, doc_id) AS rn,
             count(*) OVER (PARTITION BY class) AS n FROM cd)""")
def q_split_per_class(spark, sf):
    ensure_checkpoint_dir(spark)
    rows = classified(spark, sf).select("doc_id", "class").checkpoint()  # classified once, texts left behind
    return C.split_per_class(rows, "class", "doc_id", 0.9, True, P.SEED)


@register("corpus_global_split", f"""
    SELECT doc_id, CASE WHEN rn <= floor(n * 0.9) THEN 'train' ELSE 'val' END AS split FROM (
      SELECT doc_id, row_number() OVER (ORDER BY {S.shuffle_key(P.SEED, 'doc_id')}, doc_id) AS rn, count(*) OVER () AS n
      FROM documents)""")
def q_global_split(spark, sf):
    return C.global_split(docs(spark, sf), "doc_id", 0.9, P.SEED).select("doc_id", "split")


def labelled(spark, sf):
    """Documents with a three-way label from the quality/toxic flags (D10 binary maps)."""
    lab = read_table(spark, sf, "labels")
    lab = lab.select(
        "doc_id",
        F.when(F.col("toxic") == 1, "struggling").when(F.col("quality") == 1, "motivated").otherwise("neutral").alias("label"),
    )
    return docs(spark, sf).join(lab, "doc_id")


_LABELLED_SQL = """lab AS (
      SELECT d.doc_id, coalesce(d.text, '') AS text,
             CASE WHEN l.toxic = 1 THEN 'struggling' WHEN l.quality = 1 THEN 'motivated' ELSE 'neutral' END AS label
      FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


@register("corpus_stratified_split", f"""
    WITH {_LABELLED_SQL}
    SELECT doc_id, label, CASE WHEN rn <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM (
      SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {S.shuffle_key(P.SEED, 'doc_id')}, doc_id) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM lab)""")
def q_stratified_split(spark, sf):
    return C.stratified_split(labelled(spark, sf), "label", "doc_id", 0.2, P.SEED).select("doc_id", "label", "split")


@register("corpus_downsample", f"""
    WITH {_LABELLED_SQL}
    SELECT doc_id, label FROM (
      SELECT doc_id, label, row_number() OVER (PARTITION BY label ORDER BY {S.shuffle_key(P.SEED, 'doc_id')}, doc_id) AS rn FROM lab
      WHERE label IN ('neutral', 'motivated', 'struggling'))
    WHERE rn <= 100""")
def q_downsample(spark, sf):
    return C.downsample(labelled(spark, sf), "label", "doc_id", 100, KW.SENTIMENT_LABELS, P.SEED).select("doc_id", "label")


@register("corpus_oversample", f"""
    WITH {_LABELLED_SQL},
    c AS (SELECT count(*) AS total, count(*) FILTER (WHERE label = 'neutral') AS n_cls FROM lab),
    need AS (SELECT CAST(floor(total * 0.2) - n_cls AS BIGINT) AS need, n_cls FROM c WHERE floor(total * 0.2) - n_cls > 0 AND n_cls > 0),
    draws AS (SELECT i AS draw, (CAST(('0x' || substr({S.shuffle_key(P.SEED, 'i')}, 1, 15)) AS BIGINT) % n_cls) + 1 AS rn
              FROM need, range(need) t(i)),
    ranked AS (SELECT doc_id, label, row_number() OVER (ORDER BY doc_id) AS rn FROM lab WHERE label = 'neutral')
    SELECT doc_id, label FROM lab
    UNION ALL SELECT r.doc_id, r.label FROM draws JOIN ranked r ON r.rn = draws.rn""")
def q_oversample(spark, sf):
    return C.oversample(labelled(spark, sf).select("doc_id", "label"), "label", "neutral", "doc_id", 0.2, P.SEED)


# ------------------------------------------------------------------- reports

def _class_list_sql():
    vals = ", ".join(f"({i}, {S.q(c)})" for i, c in enumerate([*CLASSES, "GENERIC"]))
    return f"SELECT * FROM (VALUES {vals}) t(class_order, class)"


@register("corpus_class_report", f"""
    WITH {_classified_sql()}, cl AS ({_class_list_sql()}), cnt AS (SELECT class, count(*) AS n FROM cd GROUP BY class)
    SELECT cl.class_order, cl.class, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n,
           CASE WHEN coalesce(cnt.n, 0) >= 200 THEN 'OK' ELSE 'LOW' END AS status,
           CAST(greatest(0, 200 - coalesce(cnt.n, 0)) AS BIGINT) AS shortfall
    FROM cl LEFT JOIN cnt ON cnt.class = cl.class""")
def q_class_report(spark, sf):
    return C.class_report(classified(spark, sf), "class", [*CLASSES, "GENERIC"], 200)


@register("corpus_growth_report", f"""
    WITH {_classified_sql()},
    prev AS (SELECT class, count(*) AS previous FROM cd WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY class),
    nw AS (
      SELECT doc_id, class, CASE WHEN rn <= greatest(1, floor(n * 0.9)) THEN 'train' ELSE 'val' END AS split FROM (
        SELECT doc_id, class, row_number() OVER (PARTITION BY class ORDER BY {S.shuffle_key(P.SEED, 'doc_id')}, doc_id) AS rn,
               count(*) OVER (PARTITION BY class) AS n FROM cd WHERE doc_id NOT IN (SELECT doc_id FROM labels))),
    tr AS (SELECT class, count(*) AS new_train FROM nw WHERE split = 'train' GROUP BY class),
    va AS (SELECT class, count(*) AS new_val FROM nw WHERE split = 'val' GROUP BY class),
    j AS (SELECT coalesce(prev.class, tr.class, va.class) AS class,
                 CAST(coalesce(previous, 0) AS BIGINT) AS previous, CAST(coalesce(new_train, 0) AS BIGINT) AS new_train,
                 CAST(coalesce(new_val, 0) AS BIGINT) AS new_val
          FROM prev FULL JOIN tr ON tr.class = prev.class FULL JOIN va ON va.class = coalesce(prev.class, tr.class))
    SELECT class, previous, new_train, new_val, previous + new_train + new_val AS total FROM j""")
def q_growth_report(spark, sf):
    cd = classified(spark, sf)
    lab = read_table(spark, sf, "labels").select("doc_id")
    prev = cd.join(lab, "doc_id", "left_semi")
    new = C.split_per_class(cd.join(lab, "doc_id", "left_anti"), "class", "doc_id", 0.9, True, P.SEED)
    return C.growth_report(prev, new.where(F.col("split") == "train"), new.where(F.col("split") == "val"), "class")


@register("corpus_provenance_union", """
    SELECT doc_id, length(coalesce(text, '')) AS n_chars, 'documents' AS provenance FROM documents
    UNION ALL SELECT item_id AS doc_id, length(coalesce(text, '')) AS n_chars, 'benchmark' AS provenance FROM benchmark""")
def q_provenance_union(spark, sf):
    d = docs(spark, sf).select("doc_id", F.length("text").cast("long").alias("n_chars"))
    b = read_table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.length(T.nz("text")).cast("long").alias("n_chars"))
    return C.union_with_provenance({"documents": d, "benchmark": b})


@register("corpus_topup", f"""
    WITH RECURSIVE {_classified_sql()},
    cur AS (SELECT class, count(*) AS n FROM cd WHERE lang = 'en' GROUP BY class),
    cand AS (SELECT doc_id, class, CAST(substr(source, 4) AS INTEGER) AS source_order FROM cd WHERE lang <> 'en'),
    src AS (SELECT class, source_order, count(*) AS avail, row_number() OVER (PARTITION BY class ORDER BY source_order) AS k
            FROM cand GROUP BY class, source_order),
    fold AS (
      SELECT s.class, s.k, s.source_order,
             CASE WHEN coalesce(c.n, 0) < 100 THEN least(100 - coalesce(c.n, 0) + 200, 30, s.avail) ELSE 0 END AS take,
             coalesce(c.n, 0) + CASE WHEN coalesce(c.n, 0) < 100 THEN least(100 - coalesce(c.n, 0) + 200, 30, s.avail) ELSE 0 END AS cur
      FROM src s LEFT JOIN cur c ON c.class = s.class WHERE s.k = 1
      UNION ALL
      SELECT s.class, s.k, s.source_order,
             CASE WHEN f.cur < 100 THEN least(100 - f.cur + 200, 30, s.avail) ELSE 0 END,
             f.cur + CASE WHEN f.cur < 100 THEN least(100 - f.cur + 200, 30, s.avail) ELSE 0 END
      FROM fold f JOIN src s ON s.class = f.class AND s.k = f.k + 1
    ),
    ranked AS (SELECT doc_id, class, source_order, row_number() OVER (PARTITION BY class, source_order ORDER BY doc_id) AS rn FROM cand)
    SELECT r.doc_id, r.class, r.source_order FROM ranked r JOIN fold f ON f.class = r.class AND f.source_order = r.source_order
    WHERE r.rn <= f.take""")
def q_topup(spark, sf):
    cd = classified(spark, sf)
    current = cd.where(F.col("lang") == "en").groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    cand = cd.where(F.col("lang") != "en").select(
        "doc_id", "class", F.substring("source", 4, 10).cast("int").alias("source_order"), F.lit(30).alias("max_samples")
    )
    return C.need_based_topup(current, cand, target=100, extra=200, order=["doc_id"]).select("doc_id", "class", "source_order")
