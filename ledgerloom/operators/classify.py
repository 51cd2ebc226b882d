"""Evaluation and calibration of classifiers, and lexicons mined from labelled documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import wilson_lower
from ..sources.files import stored
from .windows import best_class

NONE = "(none)"


def per_class(predictions: DataFrame, lenient: bool = False, none: str = NONE) -> DataFrame:
    """Precision, recall, F1 and support of each class; ``none`` is an abstention, not a class.

    Lenient: a prediction that is the second label counts as right. Undefined precision or recall is null, F1 is 0.
    """
    right = F.col("PredLabel") == F.col("TrueLabel")
    if lenient:
        right = right | F.coalesce(F.col("PredLabel") == F.col("SecondLabel"), F.lit(False))
    true = F.when(right, F.col("PredLabel")).otherwise(F.col("TrueLabel")) if lenient else F.col("TrueLabel")
    marked = predictions.select(true.alias("t"), F.col("PredLabel").alias("p"), right.alias("right"))
    support = marked.groupBy(F.col("t").alias("Class")).agg(F.count("*").alias("Support"), F.count_if("right").alias("Hits"))
    made = marked.where(F.col("p") != none).groupBy(F.col("p").alias("Class")).agg(F.count("*").alias("Predicted"))
    out = support.join(made, "Class", "full").where(F.col("Class") != none).fillna(0)
    precision, recall = F.try_divide("Hits", "Predicted"), F.try_divide("Hits", "Support")
    f1 = F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0))
    return out.select("Class", "Support", "Predicted", "Hits", F.round(precision, 6).alias("Precision"), F.round(recall, 6).alias("Recall"), F.round(f1, 6).alias("F1"))


def scores(predictions: DataFrame, lenient: bool = False, none: str = NONE) -> DataFrame:
    """Accuracy, coverage, macro F1 and support-weighted F1 in one row."""
    each = per_class(predictions, lenient, none).agg(F.round(F.sum("Hits") / F.sum("Support"), 6).alias("Accuracy"), F.round(F.avg(F.when(F.col("Support") > 0, F.col("F1"))), 6).alias("MacroF1"), F.round(F.sum(F.col("F1") * F.col("Support")) / F.sum("Support"), 6).alias("WeightedF1"))
    covered = predictions.agg(F.round(F.avg((F.col("PredLabel") != none).cast("double")), 6).alias("Coverage"))
    return each.crossJoin(F.broadcast(covered))


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Equal-width bins (a, b] of the score, the first with 0: count, mean confidence, accuracy, gap."""
    bin_ = F.greatest(F.ceil(F.col("Score") * bins), F.lit(1))
    right = (F.col("PredLabel") == F.col("TrueLabel")).cast("double")
    out = predictions.groupBy(bin_.alias("Bin")).agg(F.count("*").alias("n"), F.avg("Score").alias("c"), F.avg(right).alias("a"))
    return out.select("Bin", "n", F.round("c", 6).alias("Confidence"), F.round("a", 6).alias("Accuracy"), F.round(F.col("a") - F.col("c"), 6).alias("Gap"))


def calibration_errors(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """Expected and maximum calibration error over bins."""
    each = calibration(predictions, bins)
    return each.agg(F.round(F.sum(F.col("n") * F.abs("Gap")) / F.sum("n"), 5).alias("ECE"), F.round(F.max(F.abs("Gap")), 5).alias("MCE"))


def brier(probabilities: DataFrame, classes: Sequence[str]) -> DataFrame:
    """The mean over documents of the summed squared distance of probabilities from the truth."""
    parts = [F.pow(F.col(f"P_{c}") - (F.col("TrueLabel") == c).cast("double"), 2) for c in classes]
    return probabilities.agg(F.round(F.avg(sum(parts[1:], parts[0])), 6).alias("Brier"))


def at_thresholds(predictions: DataFrame, thresholds: Sequence[float], none: str = NONE) -> DataFrame:
    """Coverage and accuracy of what scores at least each threshold: one pass, the thresholds as rows."""
    grid = predictions.sparkSession.createDataFrame([(float(x),) for x in thresholds], "Threshold double")
    kept = (F.col("Score") >= F.col("Threshold")) & (F.col("PredLabel") != none)
    right = kept & (F.col("PredLabel") == F.col("TrueLabel"))
    return predictions.crossJoin(F.broadcast(grid)).groupBy("Threshold").agg(F.count_if(kept).alias("nKept"), F.round(F.count_if(kept) / F.count("*"), 6).alias("Coverage"), F.round(F.try_divide(F.count_if(right), F.count_if(kept)), 6).alias("Accuracy"))


def term_statistics(incidence: DataFrame, labels: DataFrame, floor: float = 0.0, most: int = 300) -> DataFrame:
    """(Class, Term, HitsPos, HitsTot, Precision, Reach, Power) of terms that a class has more than chance.

    ``incidence`` is (DocID, Term) once each, ``labels`` (DocID, Class). Power is the Wilson lower bound of the
    precision; terms above ``floor`` stay, the strongest ``most`` of each class.
    """
    size = labels.groupBy("Class").agg(F.count("*").alias("NClass"))
    total = labels.agg(F.count("*").alias("NTrain"))
    held = incidence.join(labels, "DocID")
    per_term = held.groupBy("Term").agg(F.count("*").alias("HitsTot"))
    out = held.groupBy("Class", "Term").agg(F.count("*").alias("HitsPos")).join(per_term, "Term").join(F.broadcast(size), "Class").crossJoin(F.broadcast(total))
    precision = F.col("HitsPos") / F.col("HitsTot")
    out = out.select("Class", "Term", "HitsPos", "HitsTot", F.round(F.col("NClass") / F.col("NTrain"), 6).alias("Prior"), F.round(precision, 6).alias("Precision"), F.round(F.col("HitsPos") / F.col("NClass"), 6).alias("Reach"), F.round(wilson_lower(F.col("HitsPos"), F.col("HitsTot")), 6).alias("Power"))
    kept = out.where((F.col("Precision") > F.col("Prior")) & (F.col("Power") >= floor))
    return kept.withColumn("_r", F.row_number().over(Window.partitionBy("Class").orderBy(F.desc("Power"), "Term"))).where(F.col("_r") <= most).drop("_r")


def greedy_cover(statistics: DataFrame, incidence: DataFrame, class_size: DataFrame, min_gain: float = 0.01, most: int = 25) -> DataFrame:
    """Of each class, terms in order of power that add at least ``min_gain`` of the class's documents.

    ``incidence`` is (Class, DocID, Term). Each round chooses, for all classes at once, the strongest term that still adds
    enough: a term that adds too little once never adds more later, so this is the walk through the terms in order. Gains are
    sums over executors, and what is not yet covered is written to the shared folder after each round.
    """
    left = stored(incidence.join(statistics.select("Class", "Term", "Power"), ["Class", "Term"]).join(F.broadcast(class_size), "Class").select("Class", "Term", "Power", "NClass", "DocID"))
    chosen = None
    for rank in range(1, most + 1):
        gains = left.groupBy("Class", "Term", "Power", "NClass").agg(F.countDistinct("DocID").alias("Gain")).where(F.col("Gain") >= min_gain * F.col("NClass"))
        first = gains.groupBy("Class").agg(F.min_by(F.struct("Term", "Gain"), F.struct(-F.col("Power"), F.col("Term"))).alias("f"))
        pick = stored(first.select("Class", "f.Term", F.lit(rank).alias("Rank"), "f.Gain"))
        if pick.isEmpty():
            break
        chosen = pick if chosen is None else chosen.union(pick)
        covered = left.join(pick.select("Class", "Term"), ["Class", "Term"], "left_semi").select("Class", "DocID")
        left = stored(left.join(covered, ["Class", "DocID"], "left_anti").select(*left.columns))
    if chosen is None:
        return statistics.sparkSession.createDataFrame([], "Class string, Term string, Rank int, Gain long, Covered long")
    return chosen.withColumn("Covered", F.sum("Gain").over(Window.partitionBy("Class").orderBy("Rank")))


def apply_lexicon(tokens: DataFrame, lexicon: DataFrame, most_broadcast: int = 100_000) -> DataFrame:
    """(DocID, Class, Power, Second): the class that the strongest lexicon term of each document speaks for.

    ``tokens`` has DocID and an array of words, ``lexicon`` Class, Term (a word) and Power. Documents without any term, and
    those where two classes are equally strong, have the class of none. Only distinct words leave a document; the
    lexicon is broadcast if it is as small as lexicons are, else both are shuffled by word.
    """
    terms = lexicon.select("Term", "Class", "Power")
    words = tokens.select("DocID", F.explode(F.array_distinct("Tokens")).alias("Term"))
    hits = words.join(F.broadcast(terms) if terms.limit(most_broadcast + 1).count() <= most_broadcast else terms, "Term")
    found = best_class(hits.select("DocID", "Class", "Power"), NONE)
    return tokens.select("DocID").join(found, "DocID", "left").select("DocID", F.coalesce("Class", F.lit(NONE)).alias("Class"), "Power", "Second")


def agreement_panel(panel: DataFrame, engines: Sequence[str]) -> DataFrame:
    """How often at least one of the first k engines is right, for each k, and what each adds.

    ``panel`` has TrueLabel and a column a engine.
    """
    any_right, columns = F.lit(False), []
    for k, e in enumerate(engines):
        any_right = any_right | F.coalesce(F.col(e) == F.col("TrueLabel"), F.lit(False))
        columns.append(F.struct(F.lit(k + 1).alias("K"), F.lit(e).alias("Engine"), F.avg(any_right.cast("double")).alias("c")))
    rows = panel.agg(F.array(*columns).alias("x")).select(F.inline("x"))
    return rows.select("K", "Engine", F.round("c", 6).alias("Ceiling"), F.round(F.col("c") - F.coalesce(F.lag("c").over(Window.orderBy("K")), F.lit(0.0)), 6).alias("Marginal"))


def swap(panel: DataFrame, subset: str, arm: str, baseline: str) -> DataFrame:
    """What changes where ``subset`` holds and the baseline's answer is replaced by the arm's."""
    s = F.coalesce(F.expr(subset), F.lit(False))
    a, b = (F.coalesce(F.col(x) == F.col("TrueLabel"), F.lit(False)) for x in (arm, baseline))
    return panel.agg(F.count_if(s).alias("nSubset"), F.count_if(s & (F.col(arm) != F.col(baseline))).alias("Swapped"), F.count_if(s & a & ~b).alias("Fixed"), F.count_if(s & ~a & b).alias("Broke"), F.round((F.count_if(s & a & ~b) - F.count_if(s & ~a & b)) / F.count("*"), 6).alias("Delta"))
