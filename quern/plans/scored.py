"""Registered queries on scored tokens, templates, attention, streams and vocabularies, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import arrays, templates, tokenizer, tokens
from quern.operators import attention, blockwise, datasets, formats, indexing, measures, reports, scoring, sequences
from quern.plans.catalog import _FIRST_FIT, _FLAT, _TOK, END, LENGTH, SHARD_ROWS, VOCABULARY, _positions, _table, _tokens
from quern.plans.composed import _pairs, _scratch
from quern.streaming import growing

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


@query("""WITH z AS (SELECT vec_id, embedding[vec_id % 64 + 1]::DOUBLE AS t, list_transform(embedding, lambda x: x::DOUBLE) AS e, list_max(embedding)::DOUBLE AS m FROM embeddings),
y AS (SELECT vec_id, t, m + ln(list_sum(list_transform(e, lambda x: exp(x - m)))) AS z FROM z) SELECT vec_id, round(z - t + 0.01::DOUBLE * z * z, 6) AS loss, round(z, 6) AS log_z FROM y""")
def blockwise_loss(spark, sf_dir):
    """Cross entropy with a z term over logits in blocks of ten."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding", (F.col("vec_id") % 64).cast("int").alias("target"))
    out = blockwise.blockwise_cross_entropy(rows, "embedding", "target", "vec_id", 10, z_weight=0.01)
    return out.select("vec_id", F.round("loss", 6).alias("loss"), F.round("log_z", 6).alias("log_z"))


#: A template with role headers; what the assistant says, and the end of its turn, is generated.
CHAT = """{% for m in messages %}
{% if m['role'] == 'assistant' %}
<|{{ m['role'] }}|>
{% generation %}
{{ m['content'] }} <|end|>
{% endgeneration %}
{% else %}
<|{{ m['role'] }}|> {{ m['content'] }} <|end|>
{% endif %}
{% endfor %}"""


@query(r"""WITH m AS (SELECT conv_id, turn, role, len(list_filter(regexp_split_to_array(text, '[ \t\n\r]+'), lambda x: x <> '')) AS n FROM conversations),
o AS (SELECT *, sum(n + 2) OVER (PARTITION BY conv_id ORDER BY turn) - n - 1 AS first FROM m)
SELECT conv_id, sum(n + 2)::BIGINT AS n_tokens, sum(CASE WHEN role = 'assistant' THEN n + 1 ELSE 0 END)::BIGINT AS n_loss,
  sum(CASE WHEN role = 'assistant' THEN (n + 1) * (first + 1) + (n + 1) * n // 2 ELSE 0 END)::BIGINT AS positions FROM o
GROUP BY conv_id HAVING sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) > 0""")
def chat_template_mask(spark, sf_dir):
    """Conversations rendered by a template, tokens masked by the spans that it marks."""
    chats = formats.messages(_table(spark, sf_dir, "conversations"))
    masked = datasets.ChatFormat(template=CHAT).tokens(chats, tokenizer.tokenizer("words", vocabulary=VOCABULARY), on_missing="drop")
    return masked.select("conv_id", F.size("ids").cast("long").alias("n_tokens"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_loss"), _positions("mask").alias("positions"))


@query(r"""WITH t AS (SELECT conv_id, string_agg('<|' || role || '|>' || CASE role WHEN 'assistant' THEN chr(10) ELSE ' ' END || text || ' <|end|>' || chr(10), '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)
SELECT conv_id, md5(text) AS digest, length(text)::BIGINT AS n_chars FROM t""")
def chat_template_text(spark, sf_dir):
    """The texts that the template gives."""
    chats = templates.Template(CHAT).rendered(formats.messages(_table(spark, sf_dir, "conversations")))
    return chats.select("conv_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n_chars"))


def _scored_tokens(spark, sf_dir, modulus: int):
    """A token's log probability under a made-up model: minus its id modulo `modulus`, in 1,024ths, so that sums are exact."""
    each = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(tokens.word_hash_ids(F.col("text"), VOCABULARY)).alias("pos", "token"))
    return each.withColumn("log_prob", -(F.col("token") % modulus) / 1024.0)


@query(f"""WITH {_TOK}, t AS (SELECT doc_id, unnest(ids) AS t FROM tok), d AS (SELECT doc_id, (t % 777) - (t % 1000) AS d FROM t)
SELECT doc_id, count(*)::BIGINT AS n_tokens, sum(d) / 1024.0::DOUBLE AS total_diff, max(abs(d)) / 1024.0::DOUBLE AS largest, sum((d > 0)::INT)::BIGINT AS n_better FROM d GROUP BY doc_id""")
def log_prob_differences(spark, sf_dir):
    """Two models' log probabilities of all tokens, aligned by document and position, and what they differ by."""
    out = reports.difference_totals(reports.compared(_scored_tokens(spark, sf_dir, 1000), _scored_tokens(spark, sf_dir, 777)))
    return out.select("doc_id", "n_tokens", "total_diff", "largest", "n_better")


@query("""WITH e AS (SELECT item_id, i - 1 AS pos, strpos('etaoinshrdlu ', substr(text, i::INT, 1)) AS t, substr(text, i::INT, 1) AS c FROM benchmark, range(1, 100000) AS r(i) WHERE i <= length(text)),
s AS (SELECT item_id, pos, '<span data-diff="' || printf('%.3f', t / 8.0::DOUBLE) || '" data-lp1="' || printf('%.3f', t / 4.0::DOUBLE) || '" data-lp2="' || printf('%.3f', t / 8.0::DOUBLE) || '">' ||
  CASE WHEN t = 0 THEN '[0]' ELSE substr('etaoinshrdlu ', t::INT, 1) END || '</span>' AS span FROM e)
SELECT item_id, md5('<div class="lp">' || string_agg(span, '' ORDER BY pos) || '</div>') AS digest FROM s GROUP BY item_id""")
def log_prob_documents(spark, sf_dir):
    """Documents in HTML, a span a token; tokens are letters here, with a vocabulary of thirteen."""
    letters = "etaoinshrdlu "
    vocabulary = spark.createDataFrame([(k + 1, c) for k, c in enumerate(letters)], "token int, entry string")
    each = _table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", "")).alias("pos", "c")).withColumn("token", F.instr(F.lit(letters), F.col("c")))
    a, b = each.withColumn("log_prob", F.col("token") / 4.0), each.withColumn("log_prob", F.col("token") / 8.0)
    named = reports.token_strings(reports.compared(a, b, "item_id"), vocabulary)
    return reports.documents(reports.spans(named, {"diff": "diff", "lp1": "lp1", "lp2": "lp2"}), "item_id").select("item_id", F.md5("body").alias("digest"))


@query(r"""WITH f AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations),
w AS (SELECT u.conv_id, list_filter(regexp_split_to_array(u.text || chr(10), '[ \t\n\r]+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(u.text || chr(10) || a.text, '[ \t\n\r]+'), lambda x: x <> '') AS w
  FROM f u JOIN f a ON a.conv_id = u.conv_id AND a.role = 'assistant' AND a.r = 1 WHERE u.role = 'user' AND u.r = 1),
q AS (SELECT row_number() OVER (ORDER BY conv_id) - 1 AS i, len(a) AS s, list_transform(w, lambda x: ('0x' || substr(md5(x), 1, 7))::BIGINT % 32000) AS ids FROM w WHERE len(w) > len(a)),
c AS (SELECT i, ids[greatest(len(ids) - 95, 1):] AS ids, greatest(s - greatest(len(ids) - 96, 0), 0) AS s FROM q),
t AS (SELECT i, ids[greatest(s, 1) + 1:] AS t FROM c)
SELECT i::BIGINT AS request, round(-coalesce(list_sum(list_transform(t, lambda x: x % 1000)), 0) / 1000.0::DOUBLE, 6) AS log_prob, len(list_filter(t, lambda x: x % 10 = 3)) = 0 AS greedy FROM t WHERE len(t) > 0""")
def scored_requests(spark, sf_dir):
    """Prompts with a response, packed, scored by position and brought back; a token is the likeliest unless its id ends in 3."""
    requests = _pairs(spark, sf_dir).withColumnRenamed("sources_len", "prompt_length")
    score = lambda p: p.withColumn("log_prob", -(F.col("target") % 1000) / 1000.0).withColumn("best", F.when(F.col("target") % 10 == 3, -1).otherwise(F.col("target")))
    return scoring.score_requests(requests, 96, 4, score).select("request", F.round("log_prob", 6).alias("log_prob"), "greedy")


@query(f"""WITH {_TOK}, {_FLAT}, s AS (SELECT seq, pos, coalesce(sum((t = 32000)::INT) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM chunk),
p AS (SELECT q.seq, q.pos AS q, k.pos AS k FROM s q JOIN s k ON q.seq = k.seq AND k.pos <= q.pos - 1 AND q.pos - k.pos < 12 AND q.seg = k.seg WHERE (q.pos + k.pos) % 5 <> 0),
r AS (SELECT *, k - row_number() OVER (PARTITION BY seq, q ORDER BY k) AS run FROM p)
SELECT seq::BIGINT AS seq, q::INT AS q, min(k)::INT AS first, max(k)::INT AS last FROM r GROUP BY seq, q, run""")
def attention_runs(spark, sf_dir):
    """Runs of keys that a query sees: strictly before it, within a window of 12, of its segment, and of an explicit mask."""
    seqs = sequences.concat_and_chunk(_tokens(spark, sf_dir, True), LENGTH).select("seq", arrays.end_segments(F.col("tokens"), END).alias("segments"))
    # all pairs of positions of one sequence: its length bounds them
    grid = spark.range(LENGTH * LENGTH).select(F.floor(F.col("id") / LENGTH).cast("int").alias("q"), (F.col("id") % LENGTH).cast("int").alias("k"))
    mask = attention.Mask(offset=-1, window=12, explicit=grid.where((F.col("q") + F.col("k")) % 5 != 0))
    return attention.sequence_runs(seqs, mask).select("seq", "q", "first", "last")


@query(f"""WITH {_TOK}, {_FLAT}, s AS (SELECT seq, pos, coalesce(sum((t = 32000)::INT) OVER (PARTITION BY seq ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg FROM chunk)
SELECT q.seq::BIGINT AS seq, q.pos::INT AS q, min(k.pos)::INT AS first, max(k.pos)::INT AS last FROM s q JOIN s k ON q.seq = k.seq AND k.pos <= q.pos AND q.seg = k.seg GROUP BY ALL""")
def causal_attention_runs(spark, sf_dir):
    """The plain causal mask over segments, one run a query."""
    seqs = sequences.concat_and_chunk(_tokens(spark, sf_dir, True), LENGTH).select("seq", arrays.end_segments(F.col("tokens"), END).alias("segments"))
    return attention.causal_sequence_runs(seqs).select("seq", "q", "first", "last")


def _streamed(spark, sf_dir, stream):
    """Token rows by shard, written by and by and read as a stream to its end."""
    place = _scratch(spark)
    rows = _tokens(spark, sf_dir).select(F.floor(F.col("idx") / SHARD_ROWS).cast("string").alias("source"), F.col("idx").cast("long").alias("idx"), F.slice("ids", 1, 512).alias("ids"))
    n = rows.count()
    last = (F.col("idx") % SHARD_ROWS == SHARD_ROWS - 1) | (F.col("idx") == n - 1)
    marked = rows.withColumn("last", last)
    for k in range(3):
        marked.where(F.pmod("idx", F.lit(SHARD_ROWS)).between(k * 22, k * 22 + 21)).write.mode("append").parquet(f"{place}/in/part={k}")
    # one part after the other, restarted in between: a part's rows come after those of the part before in each source
    for k in range(3):
        source = spark.readStream.schema(marked.schema).parquet(f"{place}/in/part={k}" if k == 0 else f"{place}/in/part={{{','.join(map(str, range(k + 1)))}}}")
        stream(source).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/check").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out")


@query(f"""WITH RECURSIVE {_TOK}, {_FIRST_FIT}, p AS (SELECT shard, pack, idx, n FROM step WHERE n > 0)
SELECT shard::BIGINT AS shard, pack::BIGINT AS pack, count(*)::BIGINT AS n_segments, sum(n)::BIGINT AS n_tokens, min(idx)::BIGINT AS first_segment FROM p GROUP BY shard, pack""")
def streamed_packs(spark, sf_dir):
    """First-fit packs of a stream in three parts with restarts between them: those of the batch."""
    packs = _streamed(spark, sf_dir, lambda rows: growing.pack_stream(rows, 512, 8, 4, end="last"))
    own = F.filter("segments", lambda s: s >= 0)
    return packs.select(F.col("source").cast("long").alias("shard"), "pack", F.size(F.array_distinct(own)).cast("long").alias("n_segments"), F.size(own).cast("long").alias("n_tokens"), F.array_min(own).alias("first_segment"))


@query("""WITH t AS (SELECT event_type, user_id % 20 AS task, avg(value) AS v, count(*) AS n FROM events GROUP BY ALL)
SELECT event_type AS metric, round(avg(v), 6) AS macro, round(sum(v * n) / sum(n), 6) AS micro, count(*)::BIGINT AS tasks FROM t WHERE task % 5 <> 0 AND v IS NOT NULL GROUP BY event_type""")
def task_averages_skipping(spark, sf_dir):
    """Averages over tasks that have counts, without errors and aliases."""
    events = _table(spark, sf_dir, "events").withColumn("task", F.col("user_id") % 20)
    results = events.groupBy("task", F.col("event_type").alias("metric")).agg(F.avg("value").alias("value"), F.count("*").alias("m"))
    odd = results.select("task", F.concat("metric", F.lit("_stderr")).alias("metric"), "value", "m").union(results.select("task", F.lit("alias"), F.lit(0.0), "m"))
    # a task's weight differs by metric here, so metrics are told apart in the task's name
    name = F.concat_ws("/", F.col("task").cast("string"), "metric")
    both = results.union(odd).select(name.alias("task"), "metric", "value")
    counts = results.where("task % 5 <> 0").select(name.alias("task"), F.col("m").alias("n"))
    out = measures.task_averages(both, counts)
    return out.select("metric", F.round("macro", 6).alias("macro"), F.round("micro", 6).alias("micro"), "tasks")


@query(f"""WITH {_TOK}, s AS (SELECT lang, sum(len(ids)) AS tokens, sum(len(ids)) // 4096 AS seqs FROM tok GROUP BY lang), w(lang, weight) AS (VALUES ('en', 3.0::DOUBLE), ('de', 1.0::DOUBLE), ('fr', 0.0::DOUBLE)),
x AS (SELECT s.lang, tokens, seqs * 4096 AS held, coalesce(weight, 0) AS weight, coalesce(weight, 0) / 4 AS normalized FROM s LEFT JOIN w USING (lang))
SELECT lang, round(CASE WHEN tokens > held THEN tokens / nullif(held, 0)::DOUBLE - 1 END, 6) AS truncation, round(CASE WHEN tokens <= held THEN 1 - tokens / nullif(held, 0)::DOUBLE END, 6) AS padding,
  weight::DOUBLE AS weight, normalized::DOUBLE AS normalized, round(held / nullif(normalized, 0), 3) AS tokens_per_epoch FROM x""")
def corpus_statistics(spark, sf_dir):
    """Truncation, padding, weights and tokens an epoch of languages as sources of a mixture."""
    rows = _table(spark, sf_dir, "documents").select("lang", F.size(tokens.word_hash_ids(F.col("text"), VOCABULARY)).alias("n"))
    out = measures.corpus_statistics(measures.corpus_sizes(rows, "lang", "n"), "lang", {"en": 3.0, "de": 1.0, "fr": 0.0})
    return out.select("lang", F.round("truncation", 6).alias("truncation"), F.round("padding", 6).alias("padding"), "weight", "normalized", F.round("tokens_per_epoch", 3).alias("tokens_per_epoch"))
