"""Sweeps over parameters, scoring of answers, and the reports made from the records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.operators import metrics

TYPES = ("factual", "numerical", "summary", "negative", "multi_doc")
DEFAULT_LABEL = "기본값"
#: How many characters of a text a judge is shown.
SOURCE_CUT, QUESTION_CUT, TEXT_CUT = 3000, 1000, 2000
VERDICT = "verdict string, reason string, completeness int, conciseness int"
#: Scores are added up in this type.
EXACT = "decimal(28,18)"


def sweep(questions: DataFrame, documents: DataFrame, sizes: list[int], overlaps: list[int], only: str | None = None) -> DataFrame:
    """Every question with its document and every pair of chunk size and overlap.

    Questions whose document is missing are dropped; ``only`` keeps documents
    with that text in their name.  The parameters are a list in the plan, so the
    product is an explode and no cross join.
    """
    params = F.array(*(F.struct(F.lit(s).alias("chunk_size"), F.lit(o).alias("chunk_overlap")) for s in sizes for o in overlaps if o < s))
    docs = documents.where(F.contains(F.col("doc"), F.lit(only))) if only else documents
    return questions.join(docs.select("doc"), "doc").withColumn("_p", F.explode(params)).select(*questions.columns, "_p.chunk_size", "_p.chunk_overlap")


def score(answers: DataFrame) -> DataFrame:
    """Records of (id, prediction, reference, ...) with all scores that need no model."""
    p, r = F.col("prediction"), F.col("reference")
    keys = F.col("key_entities") if "key_entities" in answers.columns else None
    return answers.withColumns({
        "rouge1": metrics.rouge_n(p, r, 1), "rouge2": metrics.rouge_n(p, r, 2), "rougeL": metrics.rouge_l(p, r),
        "num": metrics.number_match(p, r), "entity": metrics.entity_coverage(p, r, keys),
    })


def judge_prompt(question: Column, source: Column, answer: Column) -> Column:
    """What a judge of faithfulness is shown; long texts are cut to its limits."""
    return F.concat_ws("\n", F.substring(question, 1, QUESTION_CUT), F.substring(source, 1, SOURCE_CUT), F.substring(answer, 1, TEXT_CUT))


def verdict(reply: Column) -> Column:
    """struct(verdict, reason, completeness, conciseness) of a judge's reply; Error where it can't be read.

    The first brace to the last is taken out of a reply that reasons around its JSON.
    """
    body = F.regexp_extract(reply, r"(?s)(\{.*\})", 1)
    got = F.from_json(body, VERDICT)
    return F.when(got["verdict"].isNotNull(), got).otherwise(F.from_json(F.lit('{"verdict": "Error"}'), VERDICT))


def mean_text(x: Column) -> Column:
    """Mean over what is there, four digits, a hyphen if nothing is."""
    return F.coalesce(F.format_string("%.4f", F.avg(x)), F.lit("-"))


def share_text(x: Column, value: str = "Faithful") -> Column:
    """n/N (p%) of rows with a value, all rows in the denominator."""
    n = F.count_if(x == value)
    return F.concat(n.cast("string"), F.lit("/"), F.count("*").cast("string"), F.lit(" ("), F.format_string("%.1f", 100 * n / F.count("*")), F.lit("%)"))


def label(x: Column) -> Column:
    """A parameter's value as text, the default's name for null."""
    return F.coalesce(x.cast("string"), F.lit(DEFAULT_LABEL))


def mean(x: Column, exact: Column) -> Column:
    """Mean over what is there, whatever the order of the rows; ``exact`` is the value as ``EXACT``, null if it can't be.

    The last bits of a sum of doubles depend on their order, and they decide how
    a mean halfway between two figures is rounded.  Where a value of a group is
    no such decimal (infinite, no number, over ten digits before the point), the
    group has the mean of doubles.
    """
    return F.when(F.count(exact) == F.count(x), F.avg(exact).cast("double")).otherwise(F.avg(x))


def leaderboard(records: DataFrame) -> DataFrame:
    """(dimension, value, n, rougeL, num_accuracy, faithful, completeness) for every dimension of the report.

    One pass over the records by grouping sets; types beyond the listed ones
    have no row of their own, absent ones none either.  The overall row is there
    without records too: a row that no column counts makes its group.
    """
    dims = ["is_image_based", "chunk_size", "chunk_overlap", "temperature", "type", "doc"]
    flat = records.select(*(F.col(d).cast("string").alias(d) for d in dims), "rougeL", "num_accuracy", *(F.col(s).try_cast(EXACT).alias(f"_{s}") for s in ("rougeL", "num_accuracy")), "faithfulness", "completeness", F.lit(1).alias("_n"))
    none = records.sparkSession.range(0, 1, 1, 1).select(F.lit(None).cast("int").alias("_n"))
    flat = flat.unionByName(none, allowMissingColumns=True)
    sets = flat.groupingSets([[], *([flat[d]] for d in dims)], *(flat[d] for d in dims)).agg(
        F.grouping_id().alias("_g"), F.count("_n").alias("n"), *(mean(F.col(s), F.col(f"_{s}")).alias(s) for s in ("rougeL", "num_accuracy")),
        F.count_if(F.col("faithfulness") == "Faithful").alias("faithful"), F.avg("completeness").alias("completeness"),
    )
    all_, bits = (1 << len(dims)) - 1, {d: (1 << len(dims)) - 1 - (1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)}
    name = F.when(F.col("_g") == all_, "overall")
    for d, g in bits.items():
        name = name.when(F.col("_g") == g, d)
    value = F.when(F.col("_g") == all_, "").otherwise(F.coalesce(*dims, F.lit(DEFAULT_LABEL)))
    out = sets.select(name.alias("dimension"), value.alias("value"), "n", "rougeL", "num_accuracy", "faithful", "completeness")
    return out.where((F.col("dimension") == "overall") | (F.col("n") > 0)).where((F.col("dimension") != "type") | F.col("value").isin(*TYPES))


def markdown(board: DataFrame) -> str:
    """The report as text; the board has one row per value of a dimension."""
    order = {d: i for i, d in enumerate(("overall", "is_image_based", "chunk_size", "chunk_overlap", "temperature", "type", "doc"))}
    rows = sorted(board.collect(), key=lambda r: (order[r.dimension], TYPES.index(r.value) if r.dimension == "type" else 0, r.value))
    text = lambda x: "-" if x is None else f"{x:.4f}"
    lines, last = [], None
    for r in rows:
        if r.dimension != last:
            lines += ["", f"## {r.dimension}", "", "| value | n | ROUGE-L | Num Acc | Faithful | Completeness |", "|---|---|---|---|---|---|"]
            last = r.dimension
        rate = f"{r.faithful}/{r.n} ({100 * r.faithful / r.n:.1f}%)" if r.n else "-"
        lines.append(f"| {r.value} | {r.n} | {text(r.rougeL)} | {text(r.num_accuracy)} | {rate} | {text(r.completeness)} |")
    return "\n".join(lines).strip() + "\n"


def combos(records: DataFrame, pairs: list[tuple[int, int]]) -> DataFrame:
    """(chunk_size, chunk_overlap, n, rougeL, num_accuracy, faithful_share) of the listed pairs that occur."""
    wanted = F.struct("chunk_size", "chunk_overlap").isin(*(F.struct(F.lit(a).alias("chunk_size"), F.lit(b).alias("chunk_overlap")) for a, b in pairs))
    return records.where(wanted).groupBy("chunk_size", "chunk_overlap").agg(F.count("*").alias("n"), F.avg("rougeL").alias("rougeL"), F.avg("num_accuracy").alias("num_accuracy"), (F.count_if(F.col("faithfulness") == "Faithful") / F.count("*")).alias("faithful_share"))


def labelled(records: DataFrame, labels: DataFrame) -> DataFrame:
    """Means by document under its label, the name's first thirty characters where it has none."""
    named = records.join(labels, "doc", "left").withColumn("label", F.coalesce("label", F.substring("doc", 1, 30)))
    return named.groupBy("label").agg(F.count("*").alias("n"), F.avg("rougeL").alias("rougeL"), F.avg("num_accuracy").alias("num_accuracy"), F.coalesce(F.avg("completeness"), F.lit(0.0)).alias("completeness"))


def latest(results: DataFrame) -> DataFrame:
    """Rows of the file whose name sorts last; ``results`` has a column ``file``."""
    last = results.agg(F.max("file").alias("file"))
    return results.join(F.broadcast(last), "file", "left_semi")  # one row


def print_summary(records: DataFrame) -> DataFrame:
    """Means by set of questions, by type and by mode of documents; 0.0 where nothing is to average."""
    parts = [records.groupBy(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")).agg(F.count("*").alias("n"), F.coalesce(F.avg("rougeL"), F.lit(0.0)).alias("rougeL"), F.coalesce(F.avg("num_accuracy"), F.lit(0.0)).alias("num_accuracy")) for d in ("qa_set", "type", "doc_mode")]
    modes = Window.partitionBy("dimension")
    return parts[0].unionByName(parts[1]).unionByName(parts[2].withColumn("_m", F.count("*").over(modes)).where("_m > 1").drop("_m"))
