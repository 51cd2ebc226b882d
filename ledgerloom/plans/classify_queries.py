"""Queries of the classification algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregates as A
from ..operators import classify as C
from ..operators import windows as W
from ..sources.tables import Tables
from .registry import query

CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _per_class(lenient: bool) -> str:
    right = "(PredLabel = TrueLabel" + (" OR coalesce(PredLabel = SecondLabel, false)" if lenient else "") + ")"
    true = f"CASE WHEN {right} THEN PredLabel ELSE TrueLabel END" if lenient else "TrueLabel"
    return f"""WITH k AS (SELECT {true} AS t, PredLabel AS p, {right} AS r FROM predictions), s AS (SELECT t AS Class, count(*) AS Support, count(*) FILTER (r) AS Hits FROM k GROUP BY 1), m AS (SELECT p AS Class, count(*) AS Predicted FROM k WHERE p <> '(none)' GROUP BY 1),
    j AS (SELECT coalesce(s.Class, m.Class) AS Class, coalesce(Support, 0) AS Support, coalesce(Predicted, 0) AS Predicted, coalesce(Hits, 0) AS Hits FROM s FULL JOIN m ON s.Class = m.Class), c AS (SELECT *, CASE WHEN Predicted > 0 THEN CAST(Hits AS DOUBLE) / Predicted END AS P, CASE WHEN Support > 0 THEN CAST(Hits AS DOUBLE) / Support END AS R FROM j WHERE Class <> '(none)'),
    pc AS (SELECT Class, Support, Predicted, Hits, round(P, 6) AS "Precision", round(R, 6) AS Recall, round(CASE WHEN P + R > 0 THEN 2 * P * R / (P + R) ELSE 0 END, 6) AS F1 FROM c)"""


@query("clf_perclass", _per_class(False) + " SELECT * FROM pc")
def per_class(t: Tables) -> DataFrame:
    return C.per_class(t.predictions)


@query("clf_perclass_lenient", _per_class(True) + " SELECT * FROM pc")
def per_class_lenient(t: Tables) -> DataFrame:
    return C.per_class(t.predictions, lenient=True)


@query("clf_scores", _per_class(False) + " SELECT round(sum(Hits) / sum(Support), 6) AS Accuracy, round(avg(F1) FILTER (Support > 0), 6) AS MacroF1, round(sum(F1 * Support) / sum(Support), 6) AS WeightedF1, (SELECT round(avg(CASE WHEN PredLabel <> '(none)' THEN 1.0 ELSE 0.0 END), 6) FROM predictions) AS Coverage FROM pc")
def scores(t: Tables) -> DataFrame:
    return C.scores(t.predictions)


@query("clf_confusion", "SELECT TrueLabel, " + ", ".join(f"count(*) FILTER (PredLabel = '{c}') AS \"{c}\"" for c in [*CLASSES, "(none)"]) + " FROM predictions GROUP BY 1")
def confusion(t: Tables) -> DataFrame:
    return t.predictions.groupBy("TrueLabel").pivot("PredLabel", [*CLASSES, "(none)"]).agg(F.count(F.lit(1))).fillna(0)


@query("clf_effect", "SELECT ConfigName, round(avg(Score), 6) AS Mean, round(stddev_samp(Score), 6) AS Sd, count(*) AS n FROM predictions GROUP BY 1")
def effect(t: Tables) -> DataFrame:
    return t.predictions.groupBy("ConfigName").agg(F.round(F.avg("Score"), 6).alias("Mean"), F.round(F.stddev_samp("Score"), 6).alias("Sd"), F.count("*").alias("n"))


@query("clf_fold_shares", "WITH g AS (SELECT * FROM (SELECT DISTINCT TrueLabel FROM predictions) a CROSS JOIN (SELECT DISTINCT Fold FROM predictions) b), c AS (SELECT TrueLabel, Fold, count(*) AS n FROM predictions GROUP BY 1, 2) SELECT TrueLabel, Fold, coalesce(n, 0) AS n, round(CAST(coalesce(n, 0) AS DOUBLE) / sum(n) OVER (PARTITION BY TrueLabel), 6) AS Share FROM g LEFT JOIN c USING (TrueLabel, Fold)")
def fold_shares(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    counted = t.predictions.groupBy("TrueLabel", "Fold").agg(F.count("*").alias("n"))
    values = t.predictions.select("TrueLabel", "Fold").distinct()
    full = A.complete(values, "TrueLabel", "Fold").join(counted, ["TrueLabel", "Fold"], "left").fillna(0, ["n"])
    return full.withColumn("Share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("TrueLabel")), 6))


_CAL = "WITH b AS (SELECT greatest(CAST(ceil(Score * 10) AS BIGINT), 1) AS Bin, count(*) AS n, avg(Score) AS c, avg(CASE WHEN PredLabel = TrueLabel THEN 1.0 ELSE 0.0 END) AS a FROM predictions GROUP BY 1)"


@query("bert_calibration", _CAL + " SELECT Bin, n, round(c, 6) AS Confidence, round(a, 6) AS Accuracy, round(a - c, 6) AS Gap FROM b")
def calibration(t: Tables) -> DataFrame:
    return C.calibration(t.predictions)


@query("bert_calibration_metrics", _CAL + " SELECT round(sum(n * abs(round(a - c, 6))) / sum(n), 5) AS ECE, round(max(abs(round(a - c, 6))), 5) AS MCE FROM b")
def calibration_metrics(t: Tables) -> DataFrame:
    return C.calibration_errors(t.predictions)


@query("bert_brier", "SELECT round(avg(power(P_A - CASE WHEN TrueLabel = 'A' THEN 1 ELSE 0 END, 2) + power(P_B - CASE WHEN TrueLabel = 'B' THEN 1 ELSE 0 END, 2) + power(P_C - CASE WHEN TrueLabel = 'C' THEN 1 ELSE 0 END, 2)), 6) AS Brier FROM probabilities")
def brier(t: Tables) -> DataFrame:
    return C.brier(t.probabilities, ["A", "B", "C"])


@query("bert_confidence_accuracy", "WITH g AS (SELECT CAST(unnest([0.0, 0.25, 0.5, 0.75, 0.95]) AS DOUBLE) AS Threshold) SELECT Threshold, count(*) FILTER (Score >= Threshold AND PredLabel <> '(none)') AS nKept, round(CAST(count(*) FILTER (Score >= Threshold AND PredLabel <> '(none)') AS DOUBLE) / count(*), 6) AS Coverage, round(CAST(count(*) FILTER (Score >= Threshold AND PredLabel <> '(none)' AND PredLabel = TrueLabel) AS DOUBLE) / nullif(count(*) FILTER (Score >= Threshold AND PredLabel <> '(none)'), 0), 6) AS Accuracy FROM predictions CROSS JOIN g GROUP BY 1")
def confidence_accuracy(t: Tables) -> DataFrame:
    return C.at_thresholds(t.predictions, [0.0, 0.25, 0.5, 0.75, 0.95])


@query("bert_margin_summary", "WITH m AS (SELECT TrueLabel, greatest(P_A, P_B, P_C) AS P1, P_A + P_B + P_C - greatest(P_A, P_B, P_C) - least(P_A, P_B, P_C) AS P2, CASE WHEN P_A >= P_B AND P_A >= P_C THEN 'A' WHEN P_B >= P_C THEN 'B' ELSE 'C' END AS Pred FROM probabilities) SELECT Pred = TrueLabel AS Correct, count(*) AS n, round(avg(P1 - P2), 6) AS Mean, round(median(P1 - P2), 6) AS Mid FROM m GROUP BY 1")
def margin_summary(t: Tables) -> DataFrame:
    sorted_ = F.sort_array(F.array("P_A", "P_B", "P_C"), False)
    pred = F.when((F.col("P_A") >= F.col("P_B")) & (F.col("P_A") >= F.col("P_C")), "A").when(F.col("P_B") >= F.col("P_C"), "B").otherwise("C")
    margin = sorted_[0] - sorted_[1]
    return t.probabilities.groupBy((pred == F.col("TrueLabel")).alias("Correct")).agg(F.count("*").alias("n"), F.round(F.avg(margin), 6).alias("Mean"), F.round(F.median(margin), 6).alias("Mid"))


@query("bert_hierarchy_agreement", "WITH m(Class, Broad) AS (VALUES ('1-URGENT', 'High'), ('2-HIGH', 'High'), ('3-MEDIUM', 'Low'), ('4-NOT SPECIFIED', 'Low'), ('5-LOW', 'Low')), x AS (SELECT p.DocID, m.Broad AS Rolled, CASE WHEN p.DocID % 8 = 0 THEN 'Low' ELSE 'High' END AS Separate, b.Broad AS Truth FROM predictions p JOIN m ON p.PredLabel = m.Class JOIN m b ON p.TrueLabel = b.Class) SELECT count(*) AS n, count(*) FILTER (Rolled = Separate) AS nAgree, round(avg(CASE WHEN Rolled = Truth THEN 1.0 ELSE 0.0 END), 6) AS RolledAccuracy, round(avg(CASE WHEN Separate = Truth THEN 1.0 ELSE 0.0 END), 6) AS SeparateAccuracy FROM x")
def hierarchy(t: Tables) -> DataFrame:
    broad = t.spark.createDataFrame([(c, "High" if c < "3" else "Low") for c in CLASSES], "Class string, Broad string")
    rolled, truth = (F.broadcast(broad.select(F.col("Class").alias(c), F.col("Broad").alias(n))) for c, n in (("PredLabel", "Rolled"), ("TrueLabel", "Truth")))
    x = t.predictions.join(rolled, "PredLabel").join(truth, "TrueLabel").withColumn("Separate", F.when(F.col("DocID") % 8 == 0, "Low").otherwise("High"))
    share = lambda a: F.round(F.avg((F.col(a) == F.col("Truth")).cast("double")), 6)
    return x.agg(F.count("*").alias("n"), F.count_if(F.col("Rolled") == F.col("Separate")).alias("nAgree"), share("Rolled").alias("RolledAccuracy"), share("Separate").alias("SeparateAccuracy"))


def _panel(t: Tables) -> DataFrame:
    second = F.when(F.col("DocID") % 6 == 0, "5-LOW").otherwise(F.col("TrueLabel"))
    return t.predictions.select("DocID", "TrueLabel", F.col("PredLabel").alias("Bert"), F.when(F.col("DocID") % 4 == 1, second).alias("Keyword"), F.when(F.col("DocID") % 3 == 0, F.col("TrueLabel")).otherwise("2-HIGH").alias("Llm"))


_PANEL = "WITH panel AS (SELECT DocID, TrueLabel, PredLabel AS Bert, CASE WHEN DocID % 4 = 1 THEN CASE WHEN DocID % 6 = 0 THEN '5-LOW' ELSE TrueLabel END END AS Keyword, CASE WHEN DocID % 3 = 0 THEN TrueLabel ELSE '2-HIGH' END AS Llm FROM predictions)"


@query("orch_ceiling", _PANEL + ", c AS (SELECT avg(CASE WHEN Bert = TrueLabel THEN 1.0 ELSE 0.0 END) AS a, avg(CASE WHEN Bert = TrueLabel OR coalesce(Keyword = TrueLabel, false) THEN 1.0 ELSE 0.0 END) AS b, avg(CASE WHEN Bert = TrueLabel OR coalesce(Keyword = TrueLabel, false) OR Llm = TrueLabel THEN 1.0 ELSE 0.0 END) AS d FROM panel) SELECT 1 AS K, 'Bert' AS Engine, round(a, 6) AS Ceiling, round(a, 6) AS Marginal FROM c UNION ALL SELECT 2, 'Keyword', round(b, 6), round(b - a, 6) FROM c UNION ALL SELECT 3, 'Llm', round(d, 6), round(d - b, 6) FROM c")
def ceiling(t: Tables) -> DataFrame:
    return C.agreement_panel(_panel(t), ["Bert", "Keyword", "Llm"])


@query("orch_swap", _PANEL + " SELECT count(*) FILTER (Keyword IS NOT NULL) AS nSubset, count(*) FILTER (Keyword IS NOT NULL AND Keyword <> Bert) AS Swapped, count(*) FILTER (Keyword = TrueLabel AND Bert <> TrueLabel) AS Fixed, count(*) FILTER (Keyword <> TrueLabel AND Bert = TrueLabel) AS Broke, round(CAST(count(*) FILTER (Keyword = TrueLabel AND Bert <> TrueLabel) - count(*) FILTER (Keyword <> TrueLabel AND Bert = TrueLabel) AS DOUBLE) / count(*), 6) AS Delta FROM panel")
def swap(t: Tables) -> DataFrame:
    return C.swap(_panel(t), "Keyword is not null", "Keyword", "Bert")


@query("orch_windows", _PANEL + " SELECT CASE WHEN grouping(x) = 1 THEN 'All' ELSE x END AS Split, count(*) AS n, round(avg(CASE WHEN Bert = TrueLabel THEN 1.0 ELSE 0.0 END), 6) AS Accuracy FROM (SELECT *, CASE WHEN Bert = Llm THEN 'agree' ELSE 'disagree' END AS x FROM panel) q GROUP BY GROUPING SETS ((x), ())")
def windows(t: Tables) -> DataFrame:
    split = _panel(t).withColumn("Split", F.when(F.col("Bert") == F.col("Llm"), "agree").otherwise("disagree"))
    return A.with_all_row(split, "Split", [F.count("*").alias("n"), F.round(F.avg((F.col("Bert") == F.col("TrueLabel")).cast("double")), 6).alias("Accuracy")], "All")


@query("orch_headline", "SELECT ConfigName, round(avg(CASE WHEN PredLabel <> '(none)' THEN 1.0 ELSE 0.0 END), 6) AS Coverage, round(avg(CASE WHEN PredLabel = TrueLabel THEN 1.0 ELSE 0.0 END), 6) AS Accuracy, round(avg(CASE WHEN PredLabel = TrueLabel THEN 1.0 ELSE 0.0 END) FILTER (PredLabel <> '(none)'), 6) AS Selective FROM predictions GROUP BY 1")
def headline(t: Tables) -> DataFrame:
    right = (F.col("PredLabel") == F.col("TrueLabel")).cast("double")
    made = F.col("PredLabel") != "(none)"
    return t.predictions.groupBy("ConfigName").agg(F.round(F.avg(made.cast("double")), 6).alias("Coverage"), F.round(F.avg(right), 6).alias("Accuracy"), F.round(F.avg(F.when(made, right)), 6).alias("Selective"))


@query("orch_perclass", "WITH e AS (SELECT TrueLabel AS Class, count(*) AS n, avg(CASE WHEN PredLabel = TrueLabel THEN 1.0 ELSE 0.0 END) AS r, avg(CASE WHEN PredLabel = TrueLabel THEN 1.0 ELSE 0.0 END) FILTER (PredLabel <> '(none)') AS s, avg(CASE WHEN PredLabel <> '(none)' THEN 1.0 ELSE 0.0 END) AS c FROM predictions GROUP BY 1) SELECT Class, n, round(r, 6) AS Recall, round(s, 6) AS RecallSel, round(c, 6) AS Coverage FROM e UNION ALL SELECT 'All categories', CAST(sum(n) AS BIGINT), round(avg(r), 6), round(avg(s), 6), round(avg(c), 6) FROM e")
def one_vs_rest(t: Tables) -> DataFrame:
    right, made = (F.col("PredLabel") == F.col("TrueLabel")).cast("double"), F.col("PredLabel") != "(none)"
    each = t.predictions.groupBy(F.col("TrueLabel").alias("Class")).agg(F.count("*").alias("n"), F.avg(right).alias("r"), F.avg(F.when(made, right)).alias("s"), F.avg(made.cast("double")).alias("c"))
    macro = each.agg(F.lit("All categories").alias("Class"), F.sum("n").alias("n"), *[F.avg(x).alias(x) for x in "rsc"])
    return each.unionByName(macro).select("Class", "n", F.round("r", 6).alias("Recall"), F.round("s", 6).alias("RecallSel"), F.round("c", 6).alias("Coverage"))


@query("orch_resolve_conf", "WITH g AS (SELECT CAST(unnest([0.3, 0.5, 0.7, 0.9]) AS DOUBLE) AS Threshold) SELECT Threshold, count(*) FILTER (Score < Threshold) AS nSubset, count(*) FILTER (Score < Threshold AND SecondLabel = TrueLabel AND PredLabel <> TrueLabel) AS Fixed, count(*) FILTER (Score < Threshold AND coalesce(SecondLabel <> TrueLabel, true) AND PredLabel = TrueLabel) AS Broke FROM predictions CROSS JOIN g GROUP BY 1")
def resolve_conf(t: Tables) -> DataFrame:
    grid = t.spark.createDataFrame([(0.3,), (0.5,), (0.7,), (0.9,)], "Threshold double")
    low, fix = F.col("Score") < F.col("Threshold"), F.coalesce(F.col("SecondLabel") == F.col("TrueLabel"), F.lit(False))
    right = F.col("PredLabel") == F.col("TrueLabel")
    return t.predictions.crossJoin(F.broadcast(grid)).groupBy("Threshold").agg(F.count_if(low).alias("nSubset"), F.count_if(low & fix & ~right).alias("Fixed"), F.count_if(low & ~fix & right).alias("Broke"))


_W = "greatest(least((p + 3.8414588206941245 / (2 * n) - 1.959963984540054 * sqrt(p * (1 - p) / n + 3.8414588206941245 / (4.0 * n * n))) / (1 + 3.8414588206941245 / n), 1), 0)"
_STATS = f"""WITH lab AS (SELECT DocID, TrueLabel AS Class FROM predictions), inc AS (SELECT DISTINCT DocID, Term FROM hits), h AS (SELECT inc.DocID, Term, Class FROM inc JOIN lab USING (DocID)), tt AS (SELECT Term, count(*) AS HitsTot FROM h GROUP BY 1), sz AS (SELECT Class, count(*) AS NClass FROM lab GROUP BY 1),
    b AS (SELECT h.Class, h.Term, count(*) AS HitsPos, HitsTot, NClass FROM h JOIN tt USING (Term) JOIN sz USING (Class) GROUP BY h.Class, h.Term, HitsTot, NClass), q AS (SELECT *, CAST(HitsPos AS DOUBLE) / HitsTot AS p, HitsTot AS n FROM b),
    st AS (SELECT Class, Term, HitsPos, HitsTot, round(CAST(NClass AS DOUBLE) / (SELECT count(*) FROM lab), 6) AS Prior, round(p, 6) AS "Precision", round(CAST(HitsPos AS DOUBLE) / NClass, 6) AS Reach, round({_W}, 6) AS Power FROM q), k AS (SELECT * FROM st WHERE "Precision" > Prior QUALIFY row_number() OVER (PARTITION BY Class ORDER BY Power DESC, Term) <= 300)"""


def _statistics(t: Tables) -> DataFrame:
    labels = t.predictions.select("DocID", F.col("TrueLabel").alias("Class"))
    return C.term_statistics(t.hits.select("DocID", "Term").distinct(), labels)


@query("term_statistics", _STATS + " SELECT * FROM k")
def statistics(t: Tables) -> DataFrame:
    return _statistics(t)


@query("class_incidence", _STATS + " SELECT k.Class, k.Term, h.DocID FROM k JOIN h ON h.Class = k.Class AND h.Term = k.Term")
def class_incidence(t: Tables) -> DataFrame:
    labels = t.predictions.select("DocID", F.col("TrueLabel").alias("Class"))
    return _statistics(t).select("Class", "Term").join(t.hits.select("DocID", "Term").distinct().join(labels, "DocID"), ["Class", "Term"])


@query("wilson_lower", "WITH b AS (SELECT DocID, nWords % 50 AS k, 50 + nChars % 50 AS n FROM register), q AS (SELECT *, CAST(k AS DOUBLE) / n AS p FROM b) SELECT DocID, round(" + _W + ", 9) AS Lower FROM q")
def wilson(t: Tables) -> DataFrame:
    from ..functions.text import wilson_lower

    return t.register.select("DocID", F.round(wilson_lower(F.col("nWords") % 50, 50 + F.col("nChars") % 50), 9).alias("Lower"))


_LEXICON = [("Romance", "les", 0.9), ("Romance", "que", 0.7), ("Germanic", "und", 0.9), ("English", "that", 0.8), ("English", "with", 0.6), ("English", "que", 0.7)]


@query("kw_apply", "WITH lex(Class, Term, Power) AS (VALUES " + ", ".join(f"('{c}', '{w}', CAST({p} AS DOUBLE))" for c, w, p in _LEXICON) + """), w AS (SELECT DISTINCT doc_id AS DocID, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS Term FROM documents),
    p AS (SELECT DocID, Class, max(Power) AS Power FROM w JOIN lex USING (Term) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY DocID ORDER BY Power DESC, Class) AS k, rank() OVER (PARTITION BY DocID ORDER BY Power DESC) AS tied FROM p),
    b AS (SELECT DocID, count(*) FILTER (tied = 1) AS n, max(CASE WHEN k = 1 THEN Class END) AS First, max(Power) AS Power, max(CASE WHEN k = 2 THEN Class END) AS Second FROM r GROUP BY 1)
    SELECT d.doc_id AS DocID, CASE WHEN b.n = 1 THEN First ELSE '(none)' END AS Class, b.Power, b.Second FROM documents d LEFT JOIN b ON d.doc_id = b.DocID""")
def apply_lexicon(t: Tables) -> DataFrame:
    tokens = t.documents.select(F.col("doc_id").alias("DocID"), F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)).alias("Tokens"))
    return C.apply_lexicon(tokens, t.spark.createDataFrame(_LEXICON, "Class string, Term string, Power double"))


@query("kw_select")
def select_terms(t: Tables) -> DataFrame:
    """Greedy marginal coverage is sequential: tested against a plain loop."""
    labels = t.predictions.select("DocID", F.col("TrueLabel").alias("Class"))
    incidence = t.hits.select("DocID", "Term").distinct().join(labels, "DocID")
    return C.greedy_cover(_statistics(t), incidence, labels.groupBy("Class").agg(F.count("*").alias("NClass")))


@query("incidence", "WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 3 AND w NOT IN ('the', 'and', 'for'))) AS ws FROM documents) SELECT doc_id, unnest(list_filter(ws, lambda w: w IN ('than', 'with', 'that', 'und', 'les', 'que'))) AS Term FROM w")
def incidence(t: Tables) -> DataFrame:
    tokens = F.filter(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin("the", "and", "for"))
    lexicon = t.spark.createDataFrame([(w,) for w in ("than", "with", "that", "und", "les", "que")], "Term string")
    return t.documents.select("doc_id", F.explode(F.array_distinct(tokens)).alias("Term")).join(F.broadcast(lexicon), "Term", "left_semi").select("doc_id", "Term")


@query("kw_lexicon_stability", "SELECT Class, Term, count(DISTINCT Fold) AS nFolds, round(avg(p), 6) AS MeanPower, round(min(p), 6) AS MinPower FROM (SELECT TrueLabel AS Class, Term, Fold, CAST(count(*) AS DOUBLE) / 100 AS p FROM hits JOIN predictions USING (DocID) GROUP BY 1, 2, 3) q GROUP BY 1, 2")
def stability(t: Tables) -> DataFrame:
    per = t.hits.join(t.predictions, "DocID").groupBy(F.col("TrueLabel").alias("Class"), "Term", "Fold").agg((F.count("*") / 100).alias("p"))
    return per.groupBy("Class", "Term").agg(F.countDistinct("Fold").alias("nFolds"), F.round(F.avg("p"), 6).alias("MeanPower"), F.round(F.min("p"), 6).alias("MinPower"))


@query("kw_lexicon_final", _STATS + ", f AS (SELECT TrueLabel AS Class, Term, count(DISTINCT Fold) AS nFolds FROM hits JOIN predictions USING (DocID) GROUP BY 1, 2) SELECT k.Class, k.Term, k.Power, nFolds, row_number() OVER (PARTITION BY k.Class ORDER BY k.Power DESC, k.Term) AS Rank FROM k JOIN f ON f.Class = k.Class AND f.Term = k.Term WHERE nFolds >= 3")
def lexicon_final(t: Tables) -> DataFrame:
    folds = t.hits.join(t.predictions, "DocID").groupBy(F.col("TrueLabel").alias("Class"), "Term").agg(F.countDistinct("Fold").alias("nFolds"))
    kept = _statistics(t).join(folds, ["Class", "Term"]).where("nFolds >= 3").select("Class", "Term", "Power", "nFolds")
    return W.top_per(kept, ["Class"], 10**6, F.desc("Power"), F.col("Term")).withColumn("Rank", F.col("Rank").cast("bigint"))


@query("kw_tau_curve", "WITH g AS (SELECT CAST(unnest([0.2, 0.4, 0.6, 0.8]) AS DOUBLE) AS Tau) SELECT Tau, count(*) FILTER (Score >= Tau) AS nTerms, count(DISTINCT CASE WHEN Score >= Tau THEN PredLabel END) AS nClasses, round(CAST(count(*) FILTER (Score >= Tau) AS DOUBLE) / count(*), 6) AS Coverage, round(avg(CASE WHEN PredLabel = TrueLabel THEN 1.0 ELSE 0.0 END) FILTER (Score >= Tau), 6) AS Selective FROM predictions CROSS JOIN g GROUP BY 1")
def tau_curve(t: Tables) -> DataFrame:
    grid = t.spark.createDataFrame([(0.2,), (0.4,), (0.6,), (0.8,)], "Tau double")
    kept, right = F.col("Score") >= F.col("Tau"), (F.col("PredLabel") == F.col("TrueLabel")).cast("double")
    return t.predictions.crossJoin(F.broadcast(grid)).groupBy("Tau").agg(F.count_if(kept).alias("nTerms"), F.countDistinct(F.when(kept, F.col("PredLabel"))).alias("nClasses"), F.round(F.count_if(kept) / F.count("*"), 6).alias("Coverage"), F.round(F.avg(F.when(kept, right)), 6).alias("Selective"))


@query("kw_operating_point", "WITH g AS (SELECT CAST(unnest([0.2, 0.4, 0.6, 0.8]) AS DOUBLE) AS Tau), c AS (SELECT Tau, count(DISTINCT CASE WHEN Score >= Tau THEN PredLabel END) AS nClasses, round(CAST(count(*) FILTER (Score >= Tau) AS DOUBLE) / count(*), 6) AS Coverage, round(avg(CASE WHEN PredLabel = TrueLabel THEN 1.0 ELSE 0.0 END) FILTER (Score >= Tau), 6) AS Selective FROM predictions CROSS JOIN g GROUP BY 1) SELECT * FROM c WHERE Selective >= 0.5 ORDER BY nClasses DESC, Coverage DESC, Tau LIMIT 1")
def operating_point(t: Tables) -> DataFrame:
    return tau_curve(t).drop("nTerms").where("Selective >= 0.5").orderBy(F.desc("nClasses"), F.desc("Coverage"), "Tau").limit(1)


@query("kw_summarise_mines", "SELECT ConfigName, round(avg(a), 6) AS Mean, round(stddev_samp(a), 6) AS Sd, count(*) AS nFolds FROM (SELECT ConfigName, Fold, avg(CASE WHEN PredLabel = TrueLabel THEN 1.0 ELSE 0.0 END) AS a FROM predictions GROUP BY 1, 2) q GROUP BY 1")
def summarise_mines(t: Tables) -> DataFrame:
    per = t.predictions.groupBy("ConfigName", "Fold").agg(F.avg((F.col("PredLabel") == F.col("TrueLabel")).cast("double")).alias("a"))
    return per.groupBy("ConfigName").agg(F.round(F.avg("a"), 6).alias("Mean"), F.round(F.stddev_samp("a"), 6).alias("Sd"), F.count("*").alias("nFolds"))


@query("kw_choose_config", "WITH c AS (SELECT ConfigName, round(avg(CASE WHEN PredLabel <> '(none)' THEN 1.0 ELSE 0.0 END), 6) AS Coverage, round(avg(CASE WHEN PredLabel = TrueLabel THEN 1.0 ELSE 0.0 END) FILTER (PredLabel <> '(none)'), 6) AS Selective FROM predictions GROUP BY 1) SELECT * FROM c WHERE Coverage >= 0.25 AND Selective >= (SELECT max(Selective) FROM c WHERE Coverage >= 0.25) - 0.01 ORDER BY Coverage DESC, ConfigName LIMIT 1")
def choose_config(t: Tables) -> DataFrame:
    c = headline(t).drop("Accuracy").where("Coverage >= 0.25")
    best = c.agg(F.max("Selective").alias("best"))
    return c.crossJoin(F.broadcast(best)).where("Selective >= best - 0.01").drop("best").orderBy(F.desc("Coverage"), "ConfigName").limit(1)


@query("kw_select_grid", "SELECT concat('p', CAST(p AS STRING), '-h', h) AS Name, CAST(p AS DOUBLE) AS MinPrecision, CAST(h AS INT) AS MinHits FROM (VALUES (0.9), (0.95)) a(p) CROSS JOIN (VALUES (5), (10), (20)) b(h)")
def select_grid(t: Tables) -> DataFrame:
    a = t.spark.createDataFrame([("0.90", 0.9), ("0.95", 0.95)], "s string, MinPrecision double")
    b = t.spark.createDataFrame([(5,), (10,), (20,)], "MinHits int")
    return a.crossJoin(b).select(F.concat(F.lit("p"), "s", F.lit("-h"), "MinHits").alias("Name"), "MinPrecision", "MinHits")


@query("app_distribution", "SELECT PredLabel, count(*) AS n, round(avg(Score), 6) AS MeanScore, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 6) AS Share FROM predictions GROUP BY 1")
def app_distribution(t: Tables) -> DataFrame:
    mean = t.predictions.groupBy("PredLabel").agg(F.round(F.avg("Score"), 6).alias("MeanScore"))
    return A.share_of_total(t.predictions, ["PredLabel"]).join(mean, "PredLabel")


@query("app_coverage", "SELECT Year, count(DISTINCT HashDocument) AS nWanted, count(DISTINCT CASE WHEN PredLabel <> '(none)' THEN HashDocument END) AS nLabelled FROM register LEFT JOIN predictions USING (DocID) GROUP BY 1")
def app_coverage(t: Tables) -> DataFrame:
    met = t.register.join(t.predictions.select("DocID", "PredLabel"), "DocID", "left")
    return met.groupBy("Year").agg(F.countDistinct("HashDocument").alias("nWanted"), F.countDistinct(F.when(F.col("PredLabel") != "(none)", F.col("HashDocument"))).alias("nLabelled"))


@query("app_release", "WITH p AS (SELECT r.HashDocument, q.PredLabel AS Class, CASE WHEN q.DocID % 4 = 1 THEN q.TrueLabel END AS Kw FROM register r JOIN predictions q USING (DocID) QUALIFY row_number() OVER (PARTITION BY r.HashDocument ORDER BY r.DocID) = 1) SELECT r.DocID, p.Class, CASE WHEN p.Kw IS NULL THEN 'unchecked' WHEN p.Kw = p.Class THEN 'confirmed' ELSE 'contradicted' END AS Flag FROM register r JOIN p USING (HashDocument)")
def release(t: Tables) -> DataFrame:
    from ..operators.joins import first_per

    read = t.register.select("DocID", "HashDocument").join(t.predictions, "DocID")
    primary = first_per(read, ["HashDocument"], F.col("DocID")).select("HashDocument", F.col("PredLabel").alias("Class"), F.when(F.col("DocID") % 4 == 1, F.col("TrueLabel")).alias("Kw"))
    flag = F.when(F.col("Kw").isNull(), "unchecked").when(F.col("Kw") == F.col("Class"), "confirmed").otherwise("contradicted")
    return t.register.select("DocID", "HashDocument").join(primary, "HashDocument").select("DocID", "Class", flag.alias("Flag"))


@query("llm_validate_answers", "SELECT ConfigName, regexp_extract(ConfigName, '[0-9]+$') AS Tier, count(*) AS nAnswers, count(*) FILTER (PredLabel = '(none)') AS nFailed, count(*) FILTER (PredLabel NOT IN ('1-URGENT', '2-HIGH', '(none)')) AS nOffSchema FROM predictions GROUP BY 1, 2")
def validate_answers(t: Tables) -> DataFrame:
    return t.predictions.groupBy("ConfigName", F.regexp_extract("ConfigName", "([0-9]+)$", 1).alias("Tier")).agg(F.count("*").alias("nAnswers"), *A.count_where(nFailed="PredLabel = '(none)'", nOffSchema="PredLabel not in ('1-URGENT', '2-HIGH', '(none)')"))


@query("llm_call_parse", "WITH a AS (SELECT DocID, '<think>hm</think> Answer: {\"label\": \"' || PredLabel || '\"}' AS Raw FROM predictions), j AS (SELECT DocID, regexp_extract(Raw, '\\{[^{}]*\\}') AS J FROM a) SELECT DocID, CASE WHEN json_extract_string(J, '$.label') IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') THEN json_extract_string(J, '$.label') END AS Answer FROM j")
def parse_answer(t: Tables) -> DataFrame:
    raw = F.concat(F.lit('<think>hm</think> Answer: {"label": "'), "PredLabel", F.lit('"}'))
    label = F.get_json_object(F.regexp_extract(raw, "(\\{[^{}]*\\})", 1), "$.label")
    return t.predictions.select("DocID", F.when(label.isin("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), label).alias("Answer"))


@query("bert_report_coverage", "SELECT ConfigName, count(DISTINCT Fold) AS nFolds, CASE WHEN count(DISTINCT Fold) = 5 THEN 'Complete' WHEN count(DISTINCT Fold) > 0 THEN 'Partial' ELSE 'NotStarted' END AS State FROM predictions WHERE NOT (ConfigName = 'config1' AND Fold = 4) GROUP BY 1")
def report_coverage(t: Tables) -> DataFrame:
    done = t.predictions.where("not (ConfigName = 'config1' and Fold = 4)").groupBy("ConfigName").agg(F.countDistinct("Fold").alias("nFolds"))
    return done.withColumn("State", F.when(F.col("nFolds") == 5, "Complete").when(F.col("nFolds") > 0, "Partial").otherwise("NotStarted"))
