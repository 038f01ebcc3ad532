"""Answer and context metrics (inventory M1-M9) as array expressions; no UDF.

The quirks are kept: an empty answer is faithful, faithfulness looks for substrings, citation
correctness is the mean of faithfulness and accuracy, and multi-hop success is accuracy.

Tokens, sorted tokens and the joined context are columns of a projection of their own. Higher-order
functions are interpreted, and an expression inside a lambda would be worked out for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import answer_tokens, normalize_answer

NAMES = ("exact_match", "f1_score", "answer_accuracy", "faithfulness", "context_precision", "context_recall", "hallucination_rate", "citation_correctness", "multi_hop_success")
_TEMPORARY = ("_a", "_g", "_sa", "_sg", "_ad", "_gd", "_text", "_cw", "_na", "_ng")


def _share(part: Column, whole: Column, empty: float) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(empty))


def _numbered(tokens: str) -> Column:
    """Sorted tokens, each with its number among its equals, so that a set of them is a multiset."""
    return F.transform(tokens, lambda t, i: F.concat_ws("#", t, (i - F.array_position(tokens, t)).cast("string")))


def prepared(df: DataFrame, answer: str = "answer", truth: str = "truth", contexts: str | None = "contexts") -> DataFrame:
    """df with the columns that the metrics read; without contexts only those of answers."""
    d = df.withColumns({"_a": answer_tokens(answer), "_g": answer_tokens(truth)})
    d = d.withColumns({"_sa": F.array_sort("_a"), "_sg": F.array_sort("_g"), "_ad": F.array_distinct("_a"), "_gd": F.array_distinct("_g")})
    d = d.withColumns({"_na": _numbered("_sa"), "_ng": _numbered("_sg")})
    if contexts is not None:
        c = F.coalesce(F.col(contexts), F.array().cast("array<string>"))
        text = F.lower(F.array_join(F.filter(c, lambda x: x.isNotNull() & (x != "")), " "))
        words = F.transform(c, lambda x: F.array_distinct(answer_tokens(x)))
        d = d.withColumns({"_text": text, "_cw": words})
    return d


def expressions(answer: str = "answer", truth: str = "truth") -> dict[str, Column]:
    """The nine metrics over prepared columns, by name."""
    empty = F.coalesce(F.col(answer), F.lit("")) == ""
    none = F.size("_cw") == 0
    same = F.size(F.array_intersect("_na", "_ng")).cast("double")
    precision, recall = same / F.size("_a"), same / F.size("_g")
    accuracy = _share(F.size(F.array_intersect("_gd", "_ad")), F.size("_gd"), 0.0)
    found = F.size(F.filter("_a", lambda t: F.contains(F.col("_text"), t)))
    faithful = F.when(empty, 1.0).when(none | (F.col("_text") == ""), 0.0).otherwise(_share(found, F.size("_a"), 1.0))
    shares = F.transform("_cw", lambda w: _share(F.size(F.array_intersect("_gd", w)), F.size(w), 0.0))
    mean = F.aggregate(shares, F.lit(0.0), lambda s, x: s + x) / F.size("_cw")
    covered = F.size(F.array_intersect("_gd", F.flatten("_cw")))
    return {
        "exact_match": F.when(normalize_answer(answer) == normalize_answer(truth), 1.0).otherwise(0.0),
        "f1_score": F.when(same > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0),
        "answer_accuracy": accuracy,
        "faithfulness": faithful,
        "context_precision": F.when(none, 0.0).when(F.size("_gd") == 0, 1.0).otherwise(mean),
        "context_recall": F.when(none, 0.0).otherwise(_share(covered, F.size("_gd"), 1.0)),
        "hallucination_rate": F.when(empty, 0.0).when(none, 1.0).otherwise(1.0 - faithful),
        "citation_correctness": F.when(empty, 0.0).otherwise(0.5 * faithful + 0.5 * accuracy),
        "multi_hop_success": accuracy,
    }


def with_metrics(df: DataFrame, names: tuple[str, ...] = NAMES, answer: str = "answer", truth: str = "truth", contexts: str | None = "contexts") -> DataFrame:
    """df with the named metrics of each row; a null answer or truth is empty, null contexts are none."""
    got = expressions(answer, truth)
    return prepared(df, answer, truth, contexts).withColumns({n: got[n] for n in names}).drop(*_TEMPORARY)
