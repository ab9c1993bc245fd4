"""Queries over texts, annotations, preprocessing, models and batches."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from ..functions import text as TX, vectors as VE
from ..operators import batches as B, contexts as C, features as FE, likeness as LI, models as MO, prep as P, preprocess as M, scoring as SC, steps as ST, text as T
from ..operators.prefix import bucket_width
from ..session import cut_lineage
from . import fixtures as X
from .cleaning import _NV
from .ranking import _COV, COV_US, Ranking
from .registry import query

_S = r"[\t-\r\x1c-\x20\x85\p{Z}]+"


def docs(spark, d):
    return X.table(spark, d, "documents")


@query("t1_html_strip")
def _(spark, d):
    return X.table(spark, d, "pages").select("page_id", TX.strip_html("html").alias("body"))


@query("t2_clean_journal")
def _(spark, d):
    return docs(spark, d).select("doc_id", TX.merge_title_body(F.col("source"), F.col("text"), "This is an automatic update").alias("body"))


@query("t3_normalised_tokens", f"""SELECT doc_id, md5(replace(replace(lower(trim(regexp_replace(text, '{_S}', ' ', 'g'))), ':', 'COLON'), '|', 'PIPE')) AS text_md5,
 len(list_filter(regexp_split_to_array(text, '{_S}'), lambda w: w <> '')) AS n_tokens FROM documents""")
def _(spark, d):
    return docs(spark, d).select("doc_id", F.md5(TX.normalised("text")).alias("text_md5"), F.size(TX.tokens("text")).cast("long").alias("n_tokens"))


@query("t4_previews", r"""WITH a AS (SELECT doc_id, translate(text, chr(10) || chr(9) || chr(13), '   ') AS t FROM documents), b AS (SELECT doc_id, CASE WHEN length(t) > 175 THEN substring(t, 1, 175) || ' ...' ELSE t END AS t FROM a),
c AS (SELECT doc_id, regexp_replace(t, 'https?://\S*\s', '[link] ', 'g') AS preview FROM b) SELECT doc_id, preview, CASE WHEN regexp_matches(preview, '(^|\s|/)[^.\s]{1,3}\.[^.\s]\S*') THEN 1 ELSE 0 END AS suspicious FROM c""")
def _(spark, d):
    return docs(spark, d).select("doc_id", TX.preview("text").alias("preview")).withColumn("suspicious", TX.suspicious_link("preview").cast("long"))


@query("t5_embedding_top_up")
def _(spark, d):
    known = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("text_id"))
    texts = docs(spark, d).select(F.col("doc_id").alias("text_id"), F.col("text").alias("body"))
    return T.encode_missing(texts, known, TX.hashing_encoder())


def journal_embeddings(spark, d):
    """Each update carries the vector event_id modulo the number of vectors."""
    e = X.table(spark, d, "embeddings")
    n = e.agg(F.count("*").alias("_n"))
    j = X.journals(spark, d).join(F.broadcast(n), F.lit(True)).select(F.col("event_id").alias("text_id"), F.pmod("event_id", "_n").alias("vec_id"))
    return j.join(e.select("vec_id", "embedding"), "vec_id").select("text_id", "embedding")


_T6 = f"""l AS (SELECT p.event_id, j.event_id AS oid, row_number() OVER (PARTITION BY p.event_id ORDER BY j.us) AS pos0, row_number() OVER (PARTITION BY p.event_id ORDER BY j.us DESC) AS rn FROM journals p JOIN journals j ON j.user_id = p.user_id AND j.site_id = p.site_id AND j.us <= p.us),
x AS (SELECT l.event_id, l.rn, generate_subscripts(v.embedding, 1) AS i, CAST(unnest(v.embedding) AS DOUBLE) AS x FROM l JOIN embeddings v ON v.vec_id = l.oid % {_NV} WHERE rn <= 3)"""
for _mode, _agg in (("mean", "avg"), ("max", "max")):
    @query(f"t6_pool_{_mode}", f"""WITH {_T6}, p AS (SELECT event_id, i, {_agg}(x) AS x, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT event_id, max(n) AS n_texts, round(sum(x), 5) AS total, round(max(CASE WHEN i = 1 THEN x END), 5) AS head, round(max(CASE WHEN i = 64 THEN x END), 5) AS tail FROM p GROUP BY 1{' HAVING max(n) = 3' if _mode == 'mean' else ''}""")
    def _(spark, d, _mode=_mode):
        j = X.journals(spark, d)
        p = T.pool_recent(j, j, journal_embeddings(spark, d), _mode, strict=_mode == "mean")
        v = F.col("text_vec")
        return p.select("event_id", "n_texts", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 5).alias("total"),
                        F.round(v[0], 5).alias("head"), F.round(v[63], 5).alias("tail"))


@query("t6_pool_concat", f"""WITH {_T6}, p AS (SELECT event_id, count(DISTINCT rn) AS n, round(sum(x * (4 - rn)), 4) AS weighted FROM x GROUP BY 1) SELECT event_id, n * 64 AS size, weighted FROM p WHERE n = 3""")
def _(spark, d):
    j = X.journals(spark, d)
    p = T.pool_recent(j, j, journal_embeddings(spark, d), "concat")
    w = F.aggregate(F.transform(F.col("text_vec"), lambda x, i: x.cast("double") * (F.floor(i / 64) + 1)), F.lit(0.0), lambda a, x: a + x)
    return p.select("event_id", F.size("text_vec").cast("long").alias("size"), F.round(w, 4).alias("weighted"))


def pair_rows(w):
    """Candidate rows times source pairs with the three vectors a model needs."""
    u = w.full_users.select("user_id", "us", FE.vector(FE.USER_FEATURES).alias("v"))
    p = w.pair_flags.select("metadata_id", "cand_user", FE.vector(FE.PAIR_FEATURES).alias("pair_vec"))
    return (w.candidates.join(u.select(F.col("user_id").alias("source"), "us", F.col("v").alias("source_vec")), ["source", "us"])
            .join(u.select(F.col("user_id").alias("cand_user"), "us", F.col("v").alias("cand_vec")), ["cand_user", "us"])
            .join(p, ["metadata_id", "cand_user"]))


@query("t7_model_rows")
def _(spark, d):
    """Every candidate's full model row, reported as its size and checksum."""
    w = Ranking.of(spark, d)
    pairs = C.context_pairs(w.candidates, w.eligible, w.usps)
    pts = pairs.select(F.col("cand_user").alias("user_id"), F.col("cand_site").alias("site_id"), "us").unionByName(
        pairs.select(F.col("source").alias("user_id"), F.col("source_site").alias("site_id"), "us")).distinct()
    texts = cut_lineage(T.pool_recent(pts, w.journals, journal_embeddings(spark, d), "mean", strict=False))
    rows = FE.model_rows(pairs, w.full_users, w.pair_flags, texts)
    return rows.select("metadata_id", "source_site", "cand_user", "cand_site", "is_target", F.size("features").alias("n_features"),
                       F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 3).alias("checksum"))


DEFAULT = "Welcome to our page. We write here to keep family and friends informed in one place. Thank you for coming by."
FIRST = "Welcome to my page. I write here to keep family and friends informed in one place. Thank you for coming by."
_D = lambda t: f"""CASE doc_id % 12 WHEN 0 THEN NULL WHEN 1 THEN '{DEFAULT}' WHEN 2 THEN ' &nbsp; ' WHEN 3 THEN '{DEFAULT.replace(".", "!")}' WHEN 4 THEN '{FIRST}' WHEN 5 THEN '***  ?? 12' WHEN 6 THEN '{DEFAULT} Hello'
 WHEN 7 THEN '{DEFAULT.replace("family", "people")}' WHEN 8 THEN '{DEFAULT} See you all soon' WHEN 9 THEN '{DEFAULT.replace("Thank you", "Bye")}' WHEN 10 THEN '{DEFAULT} ' || {t} ELSE {t} END"""
_WORDS = DEFAULT.replace(".", "").split()
_LET = {w: chr(ord("A") + i) for i, w in enumerate(dict.fromkeys(_WORDS))}


@query("t8_description_categories", f"""WITH a AS (SELECT doc_id, {_D('text')} AS x FROM documents), b AS (SELECT *, trim(regexp_replace(replace(x, '&nbsp;', ' '), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS s FROM a),
c AS (SELECT *, levenshtein(array_to_string(list_transform(string_split(s, ' '), lambda w: coalesce(MAP {{{", ".join(f"'{w}': '{c}'" for w, c in _LET.items())}}}[w], '#')), ''), '{"".join(_LET[w] for w in _WORDS)}') AS dist, starts_with(s, '{" ".join(_WORDS)}') AS st FROM b)
SELECT doc_id, CASE WHEN x IS NULL THEN 'undefined' WHEN x = '{DEFAULT}' THEN 'default' WHEN s = '' THEN 'empty' WHEN s = '{" ".join(_WORDS)}' THEN 'default_strip' WHEN s = '{FIRST.replace(".", "")}' THEN '1st_person_default_strip'
 WHEN NOT regexp_matches(s, '[A-Za-z]') THEN 'non_english' WHEN dist <= 1 AND st THEN 'default_add_1word' WHEN dist <= 1 THEN 'default_edited_1word' WHEN dist <= 5 AND st THEN 'default_add_5word' WHEN dist <= 5 THEN 'default_edited_5word'
 WHEN st THEN 'added_to_default' ELSE 'uncategorized' END AS category FROM c""")
def _(spark, d):
    desc = F.expr(_D("text").replace(" || text", " || text"))
    return docs(spark, d).withColumn("x", desc).select("doc_id", T.describe(F.col("x"), DEFAULT, FIRST).alias("category"))


def labelled_docs(spark, d):
    return docs(spark, d).join(X.table(spark, d, "labels").select("doc_id", F.col("quality").cast("double").alias("label")), "doc_id").withColumnRenamed("text", "body")


@query("t9_role_classifier")
def _(spark, d):
    rows = cut_lineage(labelled_docs(spark, d))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    scored = T.fit_role_classifier(rows.filter(~held)).transform(rows.filter(held))
    hit = (F.col("prediction") == F.col("label")).cast("double")
    return scored.groupBy("source").agg(F.count("*").alias("n"), F.avg(hit).alias("accuracy"))


@query("t10_label_new_documents")
def _(spark, d):
    rows = cut_lineage(labelled_docs(spark, d))
    return T.label_new(docs(spark, d).withColumnRenamed("text", "body"), rows, T.fit_role_classifier(rows))


@query("t11_author_types", """WITH l AS (SELECT doc_id % 97 AS user_id, doc_id % 5 AS site_id, CASE WHEN quality = 1 THEN 'p' ELSE 'cg' END AS role FROM labels),
s AS (SELECT user_id, site_id, avg(CASE WHEN role = 'p' THEN 1.0 ELSE 0 END) AS p FROM l GROUP BY 1, 2), u AS (SELECT user_id, count(*) AS n, max(p) AS p1, max(CASE WHEN p < 0.8 AND p > 0.2 THEN 1 ELSE 0 END) AS m, avg(CASE WHEN p >= 0.8 THEN 1.0 ELSE 0 END) AS sp FROM s GROUP BY 1)
SELECT user_id, n AS n_sites, CASE WHEN n = 1 THEN CASE WHEN p1 >= 0.8 THEN 'p' WHEN p1 >= 0.2 THEN 'shared' ELSE 'cg' END WHEN m = 1 THEN 'shared' WHEN sp >= 0.5 THEN 'p' ELSE 'cg' END AS author_type FROM u""")
def _(spark, d):
    l = X.table(spark, d, "labels").select((F.col("doc_id") % 97).alias("user_id"), (F.col("doc_id") % 5).alias("site_id"), F.when(F.col("quality") == 1, "p").otherwise("cg").alias("role"))
    return T.author_types(l)


_ANN = """ann AS (SELECT doc_id, 'a1' AS annotator, CASE WHEN quality = 1 THEN 'p' ELSE 'cg' END AS label FROM labels UNION ALL SELECT doc_id, 'a2', CASE WHEN doc_id % 4 = 0 THEN 'pc' WHEN quality = 1 THEN 'p' ELSE 'cg' END FROM labels
 UNION ALL SELECT doc_id, 'a3', CASE WHEN doc_id % 7 = 0 THEN 'cg' WHEN toxic = 1 THEN 'pc' ELSE 'p' END FROM labels WHERE quality = 0)"""


@query("t12_resolved_annotations", f"""WITH {_ANN}, g AS (SELECT doc_id, count(DISTINCT label) AS k, bool_or(label = 'p') AND bool_or(label = 'cg') AS sk, min(CASE WHEN annotator = 'a2' THEN label END) AS pref, min(label) AS lo FROM ann GROUP BY 1)
SELECT doc_id, CASE WHEN k = 1 THEN lo ELSE coalesce(pref, lo) END AS label FROM g WHERE k = 1 OR NOT sk""")
def _(spark, d):
    l = X.table(spark, d, "labels")
    q = F.when(F.col("quality") == 1, "p").otherwise("cg")
    a = lambda name, lab, df=l: df.select("doc_id", F.lit(name).alias("annotator"), lab.alias("label"))
    ann = (a("a1", q).unionByName(a("a2", F.when(F.col("doc_id") % 4 == 0, "pc").otherwise(q)))
           .unionByName(a("a3", F.when(F.col("doc_id") % 7 == 0, "cg").when(F.col("toxic") == 1, "pc").otherwise("p"), l.filter("quality = 0"))))
    return T.resolve_annotations(ann, "a2")


@query("t13_kappa", """WITH p AS (SELECT 'quality' AS code, quality AS a, CASE WHEN doc_id % 6 = 0 THEN 1 - quality ELSE quality END AS b FROM labels UNION ALL SELECT 'toxic', toxic, CASE WHEN doc_id % 10 = 0 THEN 1 - toxic ELSE toxic END FROM labels),
s AS (SELECT code, count(*) AS n, avg(CASE WHEN a = b THEN 1.0 ELSE 0 END) AS po, avg(a) * avg(b) + (1 - avg(a)) * (1 - avg(b)) AS pe FROM p GROUP BY 1) SELECT code, n, round(po, 6) AS agreement, round((po - pe) / (1 - pe), 6) AS kappa FROM s""")
def _(spark, d):
    l = X.table(spark, d, "labels")
    flip = lambda c, m: F.when(F.col("doc_id") % m == 0, 1 - F.col(c)).otherwise(F.col(c))
    one = lambda c, m: l.select(F.lit(c).alias("code"), F.col(c).alias("a"), flip(c, m).alias("b"))
    return T.kappa(one("quality", 6).unionByName(one("toxic", 10)), ["code"], "a", "b").withColumns({c: F.round(c, 6) for c in ("agreement", "kappa")})


@query("t14_annotation_sample", """WITH r AS (SELECT DISTINCT site_id % 1000 AS text_id, participant_id FROM recs WHERE site_id % 1000 NOT IN (SELECT doc_id FROM labels WHERE quality = 1))
SELECT text_id, participant_id, count(*) OVER (PARTITION BY text_id) AS n_recipients FROM r""")
def _(spark, d):
    recs = X.recommendations(spark, d).withColumn("text_id", F.col("site_id") % 1000)
    return T.annotation_sample(recs, X.table(spark, d, "labels").filter("quality = 1").withColumnRenamed("doc_id", "text_id"))


@query("t15_code_explosion", "SELECT doc_id, trim(code) AS code FROM (SELECT doc_id, unnest(string_split(lang || '; ' || source || ';;' || CASE WHEN n_chars > 500 THEN ' long ' ELSE ' ' END, ';')) AS code FROM documents) WHERE trim(code) <> ''")
def _(spark, d):
    c = F.concat("lang", F.lit("; "), "source", F.lit(";;"), F.when(F.col("n_chars") > 500, " long ").otherwise(" "))
    return T.explode_codes(docs(spark, d).select("doc_id", c.alias("codes")), "codes")


@query("t16_style_flags", """WITH a AS (SELECT doc_id, lower(text) AS b, CASE WHEN doc_id % 5 > 0 THEN 1 ELSE 0 END AS h, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 0 END AS p, CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n FROM documents)
SELECT doc_id, CASE WHEN h = 0 THEN 'none' WHEN p = 1 AND n = 1 THEN 'both' WHEN p = 1 THEN 'pos' WHEN n = 1 THEN 'neg' ELSE 'neut' END AS health_cat, CASE WHEN contains(b, 'http') OR contains(b, '[link]') THEN 1 ELSE 0 END AS has_link,
 CASE WHEN contains(b, 'please') THEN 1 ELSE 0 END AS has_please, CASE WHEN contains(b, 'we ') AND contains(b, 'i ') THEN 'both' WHEN contains(b, 'we ') THEN 'we_only' WHEN contains(b, 'i ') THEN 'i_only' ELSE 'neither' END AS pronouns FROM a""")
def _(spark, d):
    k = docs(spark, d).withColumns({"health_news": (F.col("doc_id") % 5 > 0).cast("int"), "pos_news": (F.col("doc_id") % 2 == 0).cast("int"), "neg_news": (F.col("doc_id") % 3 == 0).cast("int")})
    return k.select("doc_id", T.news_category().alias("health_cat"), *T.style_flags("text"))


# ---- preprocessing

_MF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def named_features(spark, d, names=None):
    """Candidate and source user features under their model names: all, or those in ``names``. Source features are
    found for contexts and candidate features in steps, so that pairs which need only one of them are made last and pass no
    exchange."""
    w = Ranking.of(spark, d)
    names = M.feature_names() if names is None else names
    mine = lambda t: [n for n in names if n.startswith(f"{t}_")]
    if not mine("candidate") and not mine("pair"):
        return w.candidate_pairs(w.source_features([n.removeprefix("source_") for n in mine("source")]))
    if not mine("source") and not mine("pair"):
        found = w.candidate_features([n.removeprefix("candidate_") for n in mine("candidate")])
        return found.withColumnsRenamed({n.removeprefix("candidate_"): n for n in mine("candidate")})
    side = lambda t: w.full_users.select("user_id", "us", *[F.col(n.removeprefix(f"{t}_")).alias(n) for n in mine(t)])
    return (w.candidates.select("metadata_id", "source", "cand_user", "us").distinct()
            .join(side("source").withColumnRenamed("user_id", "source"), ["source", "us"])
            .join(side("candidate").withColumnRenamed("user_id", "cand_user"), ["cand_user", "us"])
            .join(w.pair_flags.select("metadata_id", "cand_user", *[F.col(n.removeprefix("pair_")).alias(n) for n in mine("pair")]), ["metadata_id", "cand_user"]))


_DEG = "WITH p AS (SELECT DISTINCT metadata_id, us, source, cand_user FROM cand) SELECT p.metadata_id, p.cand_user, {} FROM p"
_DIN = "(SELECT count(*) FROM edges e WHERE e.{} = p.{} AND e.edge_us < p.us) AS {}"


@query("m1_feature_selector", _DEG.format(", ".join(_DIN.format(*x) for x in (("dst", "cand_user", "candidate_indegree"), ("src", "cand_user", "candidate_outdegree")))))
def _(spark, d):
    names = M.feature_names()
    cols = M.select_features(names, ["candidate", "degree"])
    return named_features(spark, d, cols).select("metadata_id", "cand_user", *cols)


@query("m2_drop_features", _DEG.format(", ".join(_DIN.format(*x) for x in (("dst", "source", "source_indegree"), ("src", "source", "source_outdegree")))))
def _(spark, d):
    names, gone = M.feature_names(), [["~source", "*"], ["source", "activity"], "source_component_size"]
    kept = M.drop_features(spark.createDataFrame([], ", ".join(f"{n} double" for n in names)), names, gone).columns
    f = named_features(spark, d, kept).drop("source", "us")
    return M.drop_features(f, names, gone)


@query("m3_one_hot_bins", """WITH q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.5) AS b, quantile_cont(l_extendedprice, 0.75) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity <= 1 THEN 1 ELSE 0 END AS l_quantity_cat_0, CASE WHEN l_quantity > 1 AND l_quantity <= 24 THEN 1 ELSE 0 END AS l_quantity_cat_1, CASE WHEN l_quantity > 24 THEN 1 ELSE 0 END AS l_quantity_cat_2,
 CASE WHEN l_extendedprice <= a THEN 1 ELSE 0 END AS l_extendedprice_cat_0, CASE WHEN l_extendedprice > a AND l_extendedprice <= b THEN 1 ELSE 0 END AS l_extendedprice_cat_1, CASE WHEN l_extendedprice > b AND l_extendedprice <= c THEN 1 ELSE 0 END AS l_extendedprice_cat_2, CASE WHEN l_extendedprice > c THEN 1 ELSE 0 END AS l_extendedprice_cat_3 FROM lineitem, q""")
def _(spark, d):
    l = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    out = M.one_hot(l, "l_quantity", [1, 24])
    return M.one_hot(out, "l_extendedprice", M.quantile_edges(l, "l_extendedprice", 4))


@query("m4_standard_scaler", f"""WITH s AS (SELECT {", ".join(f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in _MF)} FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')
SELECT l_orderkey, l_linenumber, l_partkey, {", ".join(f"round(({c} - {c}_m) / {c}_s, 5) AS {c}" for c in _MF)} FROM lineitem, s""")
def _(spark, d):
    l = X.table(spark, d, "lineitem")
    scaler = M.fit_scaler(l.filter(F.col("l_shipdate") < "1998-01-01"), _MF)
    return M.apply_scaler(l.select("l_orderkey", "l_linenumber", "l_partkey", *_MF), scaler, _MF).withColumns({c: F.round(c, 5) for c in _MF})


@query("m5_log_transform", "SELECT o_orderkey, round(ln(o_totalprice + 0.000001), 6) AS log_price FROM orders")
def _(spark, d):
    return X.table(spark, d, "orders").select("o_orderkey", F.round(M.log_eta("o_totalprice"), 6).alias("log_price"))


@query("m6_ordered_split", "WITH r AS (SELECT event_id, row_number() OVER (ORDER BY us, event_id) AS rn, count(*) OVER () AS n FROM ev) SELECT event_id, CASE WHEN rn <= floor(n * 0.99) THEN 1 ELSE 0 END AS is_train FROM r")
def _(spark, d):
    return M.ordered_split((e := X.events(spark, d).select("event_id", "us")), F.floor(F.col("us") / bucket_width(e, "us")).cast("long"), ["us", "event_id"]).select("event_id", "is_train")


@query("m7_id_index", """WITH n AS (SELECT o_custkey, row_number() OVER (ORDER BY md5(CAST(o_custkey AS VARCHAR)), o_custkey) AS i FROM orders GROUP BY 1 HAVING count(*) > 10)
SELECT o_orderkey, coalesce(i, 0) AS o_custkey_index FROM orders LEFT JOIN n USING (o_custkey)""")
def _(spark, d):
    return M.index_ids(X.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 10).select("o_orderkey", "o_custkey_index")


# ---- trained and similarity scorers

for _kind, _sql in (("cosine", "list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))"),
                    ("l2", "-sqrt(greatest(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0))")):
    @query(f"s16_similarity_{_kind}", f"""WITH vv AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
    SELECT c.metadata_id, c.cand_user, c.cand_site, round({_sql}, 5) AS score FROM cand c JOIN vv a ON a.vec_id = c.source % {_NV} JOIN vv b ON b.vec_id = (c.cand_user * 31 + c.cand_site) % {_NV}""")
    def _(spark, d, _kind=_kind):
        e = X.table(spark, d, "embeddings")
        w = Ranking.of(spark, d)
        n = F.broadcast(e.agg(F.count("*").alias("_n")))
        vec = cut_lineage(e.select("vec_id", VE.doubles("embedding").alias("_v"), VE.norm("embedding").alias("_l")))
        side = lambda df, number, s: df.join(n, F.lit(True)).withColumn("vec_id", F.pmod(number, "_n")).join(vec, "vec_id").drop("vec_id", "_n").withColumnsRenamed(
            {"_v": f"_v{s}", "_l": f"_l{s}"})
        ctx = side(w.eligible, F.col("source"), "a")
        of_pair = side(w.usps.filter(F.col("elig_us").isNotNull()).select("user_id", "site_id"), F.col("user_id") * 31 + F.col("site_id"), "b")
        own = side(C.target_rows(ctx, w.targets).drop("is_target"), F.col("cand_user") * 31 + F.col("cand_site"), "b")
        known = SC.similarity(own, "_va", "_vb", _kind, norms=("_la", "_lb")).select("metadata_id", "cand_user", "cand_site", "score")
        found = LI.candidate_similarity(ctx, of_pair, w.usps, w.activity, w.edges, _kind)
        return found.unionByName(known).withColumn("score", F.round("score", 5))


@query("s17_pointwise_classifier")
def _(spark, d):
    """Train on the train period's pointwise rows, score and rank every candidate after it."""
    w = Ranking.of(spark, d)
    rows = cut_lineage(pair_rows(w).withColumn("label", F.col("is_target").cast("double")))
    picked = C.pointwise(w.triples.filter(F.col("us") < X.TEST_START_US)).select("metadata_id", F.col("user_id").alias("cand_user"), F.col("site_id").alias("cand_site"))
    model = MO.fit_pointwise(rows.join(picked, ["metadata_id", "cand_user", "cand_site"]))
    scored = MO.score_pointwise(model, rows.filter(F.col("us") >= X.TEST_START_US), "Pointwise")
    site = cut_lineage(SC.by_model(SC.reduce_to_sites(scored, ["Pointwise"], ["is_target"]), ["Pointwise"]))
    return SC.target_metrics(SC.rank_worst_ties(site, ["model", "metadata_id"]), ["model", "metadata_id"])


@query("s18_factorisation")
def _(spark, d):
    w = Ranking.of(spark, d)
    train = M.index_ids(M.index_ids(w.inits.filter(F.col("us") < X.TEST_START_US), "user_id", 1), "site_id", 1)
    train = cut_lineage(train)
    model = MO.factorise(train, "user_id_index", "site_id_index")
    u = train.select(F.col("user_id").alias("source"), F.col("user_id_index").cast("int").alias("user")).distinct()
    s = train.select(F.col("site_id").alias("cand_site"), F.col("site_id_index").cast("int").alias("item")).distinct()
    found = ST.candidate_sites(w.eligible, w.usps, w.activity, w.edges).withColumn("is_target", F.lit(0).cast("long"))
    every = found.select("metadata_id", "source", "cand_site", "is_target").unionByName(
        w.target_rows.select("metadata_id", "source", "cand_site", "is_target").distinct())
    c = every.join(u, "source", "left").join(s, "cand_site", "left").fillna(0, ["user", "item"])
    return model.transform(c).select("metadata_id", F.col("cand_site").alias("site_id"), "is_target", F.coalesce(F.nanvl("prediction", F.lit(0.0)), F.lit(0.0)).alias("score"))


# ---- batches

_PREFS = f"{_COV}, prefs AS (SELECT metadata_id AS participant_id, site_id, score FROM cscores c WHERE model = 'MostRecentJournal')"


def prefs(spark, d):
    """What every participant ranks: a site's latest journal."""
    shared = Ranking.of(spark, d).coverage
    return replace(shared, sites=shared.sites.select("site_id", F.col("MostRecentJournal").alias("score")))


@query("b1_draft")
def _(spark, d):
    p = B.allowed(prefs(spark, d), X.recommendations(spark, d), X.sites(spark, d).filter("is_spam = 1"))
    return B.draft(p, capacity=10, picks=5)


@query("b2_exclude_previous", f"WITH {_PREFS} SELECT participant_id, site_id FROM prefs p WHERE NOT EXISTS (SELECT 1 FROM recs r WHERE r.participant_id = p.participant_id AND r.site_id = p.site_id) AND site_id NOT IN (SELECT site_id FROM sites WHERE is_spam = 1)")
def _(spark, d):
    return B.exclude(prefs(spark, d), X.recommendations(spark, d), X.sites(spark, d).filter("is_spam = 1")).select("participant_id", "site_id")


@query("b3_batch_table", f"""WITH {_COV}, ju AS (SELECT site_id, arg_max(event_id, us) AS journal_oid FROM journals GROUP BY 1), pv AS (SELECT ju.site_id, journal_oid, translate(text, chr(10) || chr(9) || chr(13), '   ') AS t FROM ju JOIN documents ON doc_id = journal_oid % (SELECT count(*) FROM documents)),
p2 AS (SELECT site_id, journal_oid, regexp_replace(CASE WHEN length(t) > 175 THEN substring(t, 1, 175) || ' ...' ELSE t END, 'https?://\\S*\\s', '[link] ', 'g') AS preview FROM pv)
SELECT metadata_id AS participant_id, string_agg(pos || ':' || site_id || ':' || journal_oid || ':' || preview, '#' ORDER BY pos) AS picks FROM crecs JOIN p2 USING (site_id) WHERE model = 'MostRecentJournal' GROUP BY 1""")
def _(spark, d):
    picks = Ranking.of(spark, d).coverage_recs.filter("model = 'MostRecentJournal'").withColumnRenamed("metadata_id", "participant_id")
    t = docs(spark, d).select(F.col("doc_id").alias("text_id"), F.col("text").alias("body"))
    j = X.journals(spark, d).join(F.broadcast(t.agg(F.count("*").alias("_n"))), F.lit(True)).withColumn("text_id", F.pmod("event_id", "_n"))
    table = B.batch_table(picks, B.latest_updates(j, t))
    item = lambda x: F.concat_ws(":", x["pos"].cast("string"), x["site_id"].cast("string"), x["journal_oid"].cast("string"), x["preview"])
    return table.select("participant_id", F.array_join(F.transform("sse_site_list", item), "#").alias("picks"))


@query("b4_participant_enrichment", "SELECT e.user_id, coalesce(c_mktsegment, 'none') AS segment FROM (SELECT DISTINCT user_id FROM ev) e LEFT JOIN customer ON c_custkey = user_id")
def _(spark, d):
    mail = lambda key: F.concat(F.lit("Customer."), F.col(key).cast("string"), F.lit("@Example.org"))
    people = X.events(spark, d).select("user_id").distinct().select("user_id", B.normalised_email(F.concat(F.lit("  "), mail("user_id"))).alias("email"))
    c = X.table(spark, d, "customer").select(B.normalised_email(F.upper(mail("c_custkey"))).alias("email"), F.col("c_mktsegment").alias("segment"))
    return P.join_validated(people, c, ["email"], contract="one_to_one").select("user_id", F.coalesce("segment", F.lit("none")).alias("segment"))


@query("b5_survey_dedup", "SELECT 'u' || user_id || '@mail.org' AS email, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us DESC) AS rn FROM ev WHERE user_id % 10 <> 3) WHERE rn = 1")
def _(spark, d):
    host = F.when(F.col("user_id") % 10 == 3, "@Internal.org").otherwise("@Mail.org ")
    r = X.events(spark, d).withColumn("raw", F.concat(F.lit("U"), F.col("user_id").cast("string"), host))
    return B.last_response(r, "raw", [F.col("us").desc()], "internal.org").select("email", "event_id")
