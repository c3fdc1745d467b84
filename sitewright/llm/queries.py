"""The numbered operators' queries, over their whole tables, and oracle SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm import ann, bpe, chat, conversation_repair, exact_dedup, html_extract, merkle, packing, quality_model, rules, secret_scan, shards, simhash
from sitewright.shared import scratch_path


def vocabulary(name: str) -> str:
    """A public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table whose files make fewer splits than there are cores, dealt over all of them.

    Larger tables stay as their splits are, so at scale nothing shuffles here.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(spread(table(spark, sf_dir, "documents")), vocabulary("word_bpe_49k.json"), with_decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(spread(table(spark, sf_dir, "documents")))


def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spread(table(spark, sf_dir, "pages"))).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, read back from the compacted store that they arrived in."""
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, scratch_path(spark, "shards"), docs.schema)
    shards.arrive(store, docs, "doc_id")
    return store.read(store.compact_all()).select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


OP5_SQL = "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents"


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(spread(table(spark, sf_dir, "documents")))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spread(table(spark, sf_dir, "documents")), vocabulary("byte_bpe_50k.json"))


#: Said by both turns of the conversation that is added to the table.
CONTROL = "</s>[INST] ok [/INST]"


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    turns = chat.canonical_turns(chat.gather(rows.unionByName(added)), id_col="conv_id", record_col="record")
    out = chat.format_turns(turns.select("conv_id", "turns"))
    back = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss")).alias("learnt"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP8_SQL = r"""
WITH all_turns AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, NULL, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'
), c AS (
  SELECT *, regexp_replace(role, '[~<|[]', '00', 'g') AS r, regexp_replace(text, '[~<|[]', '00', 'g') AS t FROM all_turns
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(r) + length(t) + 13) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id, alone
"""


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(spread(table(spark, sf_dir, "documents")), vocabulary("byte_bpe_50k.tiktoken"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "dense")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


#: The policy that query op10 and the pipeline apply.
POLICY = "prose-1"


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.ledger(spread(table(spark, sf_dir, "documents"))), POLICY)
    base = F.col("failed").bitwiseAND(F.lit(rules.mask_of("base-1"))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d
), m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS BIGINT) AS n_upper,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(len(ls) AS BIGINT) AS n_lines
  FROM w
), g AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1
), c AS (
  SELECT doc_id, CAST(sum(least(8, coalesce(nxt - i, 8))) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM r) GROUP BY doc_id
), a AS (
  SELECT m.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN c USING (doc_id)
), f AS (
  SELECT *, CAST(CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN 10 * n_upper > 3 * word_chars THEN 8 ELSE 0 END
    + CASE WHEN n_lines > 4 AND 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END
    + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END AS BIGINT) AS failed
  FROM a
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, failed
FROM f
"""


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations' rows with faults by their ids and turns: dropped, emptied, cut, repeated or of the wrong role."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    cut = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    held = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), code.alias("code")).where("code <> 0")
    twice = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    return held.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), cut.alias("text"), twice).drop("copy")


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    found = conversation_repair.report(damaged(rows)).withColumnRenamed("conv_id", "found_id")
    ids = rows.select("conv_id").distinct()
    none = {c: F.lit(0).cast("long") for c in conversation_repair.REPORT} | {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select("conv_id", *(F.coalesce(c, none[c]).alias(c) for c in conversation_repair.REPORT))


def op12_merkle(spark: SparkSession, sf_dir: str, **options: int) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    fields = lambda text: merkle.leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf, tampered = fields(F.col("text")), F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = docs.select(merkle.group_key(F.col("lang")).alias("grp"), "doc_id", leaf.alias("node"), F.when(tampered, fields(lower)).alias("claim"))
    found = merkle.prove(rows.withColumn("claim", F.coalesce("claim", "node")), id_type=docs.schema["doc_id"].dataType.simpleString(), **options)
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op13_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(spread(table(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER same AS nth
  FROM d WINDOW same AS (PARTITION BY norm ORDER BY points DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, nth = 1 AS kept, sha256(norm) AS text_sha256 FROM g
"""


def queries() -> dict:
    found = (op1_bpe, op2_quality, op3_neighbours, op4_html, op5_shards, op6_simhash, op7_packing, op8_chat, op9_secrets, op10_rules, op11_repair, op12_merkle, op13_exact)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_shards": OP5_SQL, "op8_chat": OP8_SQL, "op10_rules": OP10_SQL, "op13_exact": OP13_SQL}
