"""Reports on scored tokens: two models' log probabilities side by side, documents in HTML, metrics as JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.scalars import escaped_html, flat_columns, visible

#: Vocabularies of up to so many entries are broadcast to the tokens, larger ones joined.
BROADCAST_ENTRIES = 1_000_000

_HEAD = """<html><head><meta charset="utf-8"><style>.lp span {font-family: monospace; white-space: pre-wrap}</style></head><body>
<p>{legend}</p>
"""
_FOOT = """
<script>
for (const s of document.querySelectorAll(".lp span")) {{
  const d = s.dataset, shown = Math.max(-{limit}, Math.min({limit}, parseFloat(d.diff ?? d.lp)));
  const strength = (1 - Math.exp(-Math.abs(shown) / 3)).toFixed(2);
  s.style.background = `rgba(${{shown > 0 ? "60, 110, 220" : "240, 150, 30"}}, ${{strength}})`;
  s.title = Object.entries(d).map(([k, v]) => k + " " + v).join(", ");
}}
</script></body></html>"""


def token_strings(tokens: DataFrame, vocabulary: DataFrame, token: str = "token", entry: str = "entry") -> DataFrame:
    """tokens with the entry of each id; an id that the vocabulary (token, entry) lacks shows as its number in brackets."""
    few = vocabulary.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES
    named = vocabulary.select(token, F.col(entry).alias("__entry"))
    out = tokens.join(F.broadcast(named) if few else named, token, "left")
    return out.withColumn(entry, F.coalesce("__entry", F.concat(F.lit("["), F.col(token).cast("string"), F.lit("]")))).drop("__entry")


def compared(a: DataFrame, b: DataFrame, doc: str = "doc_id", pos: str = "pos", token: str = "token", log_prob: str = "log_prob") -> DataFrame:
    """(doc, pos, token, lp1, lp2, diff): two models' log probabilities of the same tokens, aligned by document and position.

    A position that one of them lacks, and one where the tokens differ, raises. A document's tokens are gathered in order on each
    side, so that documents are shuffled and joined, not single tokens, and sums by document, which each have one task, shuffle a row a document.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        rows = F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(token).alias("token"), F.col(log_prob).alias("lp")))
        return df.groupBy(doc).agg(F.sort_array(rows).alias(name))

    # null and absent documents on one side have no rows there
    both = side(a, "__a").join(side(b, "__b"), doc, "full").select(doc, F.explode(F.arrays_zip(*(F.coalesce(x, F.array()) for x in ("__a", "__b")))).alias("__z"))
    both = both.select(doc, F.col("__z.0").alias("__a"), F.col("__z.1").alias("__b"))
    at = F.least("__a.pos", "__b.pos")
    wrong = F.raise_error(F.concat(F.lit("the tables differ at document "), F.coalesce(F.col(doc).cast("string"), F.lit("null")), F.lit(", position "), F.coalesce(at.cast("string"), F.lit("null"))))
    same = F.coalesce((F.col("__a.pos") == F.col("__b.pos")) & (F.col("__a.token") == F.col("__b.token")), F.lit(False))
    checked = F.when(same, F.col("__a.token")).otherwise(wrong.cast(a.schema[token].dataType))
    return both.select(doc, at.alias(pos), checked.alias(token), F.col("__a.lp").alias("lp1"), F.col("__b.lp").alias("lp2"), (F.col("__a.lp") - F.col("__b.lp")).alias("diff"))


def difference_totals(differences: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, n_tokens, total_diff, mean_diff, largest, n_better): how far the first model's log probabilities are from the second's in each document."""
    return differences.groupBy(doc).agg(F.count("*").alias("n_tokens"), F.sum("diff").alias("total_diff"), F.avg("diff").alias("mean_diff"), F.max(F.abs("diff")).alias("largest"), F.count_if(F.col("diff") > 0).alias("n_better"))


def _number(value: Column) -> Column:
    return F.call_function("format_number", value, F.lit("0.000"))


def spans(tokens: DataFrame, values: dict[str, str], entry: str = "entry", best: str | None = None) -> DataFrame:
    """tokens with span: the entry, escaped, with numbers as data attributes; values: attribute -> column; best: a column with the likeliest entry."""
    parts = [F.concat(F.lit(f' data-{name}="'), _number(F.col(column)), F.lit('"')) for name, column in values.items()]
    if best:
        parts.append(F.concat(F.lit(' data-best="'), escaped_html(F.col(best)), F.lit('"')))
    return tokens.withColumn("span", F.concat(F.lit("<span"), *parts, F.lit(">"), escaped_html(visible(F.col(entry))), F.lit("</span>")))


def documents(tokens: DataFrame, doc: str = "doc_id", pos: str = "pos") -> DataFrame:
    """(doc, body): the spans of each document in order."""
    each = tokens.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(pos, "span"))).alias("r"))
    return each.select(doc, F.concat(F.lit('<div class="lp">'), F.array_join(F.col("r.span"), ""), F.lit("</div>")).alias("body"))


def write_pages(bodies: DataFrame, path: str, legend: str, doc: str = "doc_id", per_page: int = 128, limit: float = 5.0) -> int:
    """Writes documents as whole HTML files of `per_page` documents each, path/page=0, page=1 and so on; gives their number.

    Pages are cut by a dense index, so each is one row, however many documents there are.
    """
    from quern.operators.indexing import dense_index

    placed = dense_index(bodies.select(doc, "body"), doc, "__at").withColumn("page", F.floor(F.col("__at") / per_page))
    pages = placed.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("__at", "body"))).alias("r"))
    text = F.concat(F.lit(_HEAD.replace("{legend}", legend)), F.array_join(F.col("r.body"), "<br><br>\n"), F.lit(_FOOT.format(limit=limit)))
    pages.select("page", text.alias("value")).repartition("page").write.mode("overwrite").partitionBy("page").text(path)
    return pages.sparkSession.read.text(path, wholetext=True).count()


def write_comparison(a: DataFrame, b: DataFrame, vocabulary: DataFrame, path: str, doc: str = "doc_id", per_page: int = 128, limit: float = 5.0) -> int:
    """The report on two models' tables of (doc, pos, token, log_prob), with entries from a vocabulary of (token, entry)."""
    named = token_strings(compared(a, b, doc), vocabulary)
    marked = spans(named, {"diff": "diff", "lp1": "lp1", "lp2": "lp2"})
    return write_pages(documents(marked, doc), path, "Blue: likelier under the first model; orange: under the second.", doc, per_page, limit)


# metrics as JSON lines


def metric_lines(metrics: DataFrame, step: str | None = None) -> DataFrame:
    """(value): a record a row, nested names joined by "/": {"event": "log", "step": ..., "metrics": {...}}."""
    names = [c for c in metrics.columns if c != step]
    flat = flat_columns(metrics.select(*names).schema)
    at = F.col(step).cast("long") if step else F.lit(None).cast("long")
    return metrics.select(F.to_json(F.struct(F.lit("log").alias("event"), at.alias("step"), F.struct(*flat).alias("metrics")), {"ignoreNullFields": "false"}).alias("value"))


class MetricLog:
    """A folder of JSON lines: parameters, metrics by step, a summary, and at the end a record that joins the summary and the last metrics.

    Tables are logged by tasks, as many rows as they have; only the last row of a table, by its step, is read back for the end.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.last: dict[str, object] = {}
        self.summed: dict[str, object] = {}

    def _write(self, record: dict) -> None:
        self.spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("append").text(self.path)

    @staticmethod
    def _flat(metrics: dict, prefix: str = "") -> dict[str, object]:
        out: dict[str, object] = {}
        for name, value in metrics.items():
            out |= MetricLog._flat(value, f"{prefix}{name}/") if isinstance(value, dict) else {f"{prefix}{name}": value}
        return out

    def parameters(self, values: dict) -> None:
        self._write({"event": "parameters", "parameters": values})

    def log(self, metrics: dict, step: int | None = None) -> None:
        self._write({"event": "log", "step": step, "metrics": metrics})
        if step is not None:
            self.last |= self._flat(metrics)

    def log_table(self, metrics: DataFrame, step: str) -> None:
        """A record for each row of a table of metrics by step."""
        metric_lines(metrics, step).write.mode("append").text(self.path)
        latest = metrics.orderBy(F.col(step).desc()).limit(1)
        row = latest.select(*flat_columns(latest.drop(step).schema)).first()
        self.last |= row.asDict() if row else {}

    def summary(self, metrics: dict) -> None:
        self._write({"event": "summary", "metrics": metrics})
        self.summed |= self._flat(metrics)

    def artifact(self, path: str, name: str | None = None) -> None:
        self._write({"event": "artifact", "path": path, "name": name})

    def finish(self) -> dict[str, object]:
        record = {**self.summed, **self.last}
        self._write({"event": "finish", "summary": record})
        return record
