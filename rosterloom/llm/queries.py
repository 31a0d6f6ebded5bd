"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audio, bpe, centroids, chat, decontaminate, filter_audit, html_extract, language_id, line_dedup, mil_quality, shuffle_shards, simhash, suffix_dedup
from .common import table

#: The last bytes of a stored text that op9 gives a checksum of.
TAIL = 16
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation repaired to legal turns at the least cost, rendered piece by piece."""
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op2_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled uniformly into 40 shards whose row counts are at most one apart."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shuffle_shards.shard(docs, ["doc_id", "text_crc32", "size"], 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (document, benchmark item) within the item's error budget, at its best place."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_hits(docs, items, keep_text=False)
    return found.select("doc_id", F.explode("hits").alias("h")).select("doc_id", "h.item_id", "h.edits", "h.start", "h.end")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from the labels outside the held-out fold."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = mil_quality.train(docs, labels.filter(mil_quality.fold() != 0))
    scored = mil_quality.score(docs.select("doc_id", "text"), model, keep_text=False)
    held_out = mil_quality.fold() == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from the texts outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(mil_quality.fold() != 0))
    labelled = language_id.label(docs.select("doc_id", "text"), model, keep_text=False)
    held_out = mil_quality.fold() == 0
    return labelled.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fingerprint of every document and the smallest id it reaches over near fingerprints."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that over a tenth of its source's documents share."""
    docs = table(spark, sf_dir, "documents")
    kept = line_dedup.drop_lines(docs, F.col("source"))
    return kept.select("doc_id", "source", "n_lines", "n_dropped", F.md5("text").alias("kept_md5"))


OP7_SQL = """
WITH lines AS (
    SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
pages AS (SELECT source, count(*) AS all_pages FROM documents GROUP BY source),
common AS (
    SELECT source, trim(line) AS line FROM lines WHERE trim(line) <> '' GROUP BY source, trim(line)
    HAVING count(DISTINCT doc_id) > 1 AND count(DISTINCT doc_id) > 0.1 * (SELECT all_pages FROM pages p WHERE p.source = lines.source)),
marked AS (SELECT l.*, c.line IS NULL AS stays FROM lines l LEFT JOIN common c ON l.source = c.source AND trim(l.line) = c.line)
SELECT doc_id, source, cast(count(*) AS integer) AS n_lines, cast(count(*) FILTER (NOT stays) AS integer) AS n_dropped,
       md5(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (stays), '')) AS kept_md5
FROM marked GROUP BY doc_id, source
"""


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document, and of the bytes its ids decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, RANKS, keep_text=False).select(
        "doc_id", "token_ids", F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
    )
    back = bpe.decode(coded, RANKS)
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as 8-bit sound, read back and described."""
    stored = audio.store(table(spark, sf_dir, "documents").select("doc_id", "text"))
    seen = audio.describe(stored.select("doc_id", "n_bytes", "media"))
    feature = F.concat(F.lit("frames="), "n_frames", F.lit(";segments="), F.size("segments"), F.lit(";tensors="), F.sha2("tensors", 256))
    return seen.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -TAIL, TAIL)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less the bytes that lie in a 400-byte string found elsewhere too.

    ``kept_text`` is what is left, to be read; half a character at a cut is U+FFFD there, the digest is of the bytes.
    """
    cut = suffix_dedup.drop_repeated(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    kept_text = F.make_valid_utf8(F.col("kept").cast("string")).alias("kept_text")
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), kept_text)


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page, taken from the container that the pages of its host agree on."""
    found = html_extract.extract(table(spark, sf_dir, "pages"), keep_html=False)
    return found.select("page_id", "url", "text", "n_chars")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster after ten rounds from eight hashed starts."""
    return centroids.cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def _op12_sql(clusters: int = 8, dims: int = 64, rounds: int = 10) -> str:
    """The rounds one after another; each is a pair of tables, assignments and new centroids."""
    square = f"list_sum(list_transform(range(1, {dims + 1}), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
    steps = []
    for r in range(rounds + 1):
        steps.append(f"a{r} AS MATERIALIZED (SELECT row_id, vec_id, v, min(struct_pack(d := {square}::BIGINT, k := k)) AS best FROM kept, c{r} GROUP BY ALL)")
        if r < rounds:
            steps.append(
                f"s{r} AS MATERIALIZED (SELECT k, pos, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT best.k AS k, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{r}) GROUP BY k, pos), "
                f"m{r} AS MATERIALIZED (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY pos) AS c FROM s{r} GROUP BY k), "
                f"c{r + 1} AS MATERIALIZED (SELECT o.k, coalesce(m.c, o.c) AS c FROM c{r} o LEFT JOIN m{r} m ON o.k = m.k)")
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, v) - 1)::INTEGER AS k, v AS c FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {clusters})),
{", ".join(steps)},
sums AS (SELECT best.k AS k, sum(best.d) AS part FROM a{rounds} GROUP BY 1)
SELECT vec_id, best.k AS cluster, best.d AS distance, part::BIGINT AS cluster_inertia, (SELECT sum(part) FROM sums)::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.best.k = c.k JOIN sums s ON s.k = c.k
"""


OP12_SQL = _op12_sql()


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, in every source, order and step."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return filter_audit.audit(docs, table(spark, sf_dir, "labels"))


OP13_SQL = """
WITH labelled AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
docs AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
flags AS (
    SELECT part, doc_id, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
           100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
           doc_id > min(doc_id) OVER (PARTITION BY t) AS e FROM docs),
masks AS (
    SELECT part, a::INTEGER + 2 * b::INTEGER + 4 * c::INTEGER + 8 * d::INTEGER + 16 * e::INTEGER AS mask, count(*) AS n,
           coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM flags LEFT JOIN labelled USING (doc_id) GROUP BY 1, 2),
letters(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
    SELECT p.f || q.f || r.f || s.f || u.f AS filter_order, [p.bit, q.bit, r.bit, s.bit, u.bit] AS bits
    FROM letters p, letters q, letters r, letters s, letters u WHERE p.bit | q.bit | r.bit | s.bit | u.bit = 31),
steps AS (
    SELECT filter_order, step::INTEGER AS step, bits[step] AS own, list_sum(list_slice(bits, 1, step - 1)) AS earlier, substr(filter_order, step, 1) AS f
    FROM orders, range(1, 6) x(step)),
figures AS (
    SELECT part, filter_order, step, f,
           coalesce(sum(n) FILTER (mask & (coalesce(earlier, 0)::INTEGER | own) = 0), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (mask & own > 0 AND mask & coalesce(earlier, 0)::INTEGER = 0), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (mask & own > 0 AND mask & coalesce(earlier, 0)::INTEGER > 0), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
           coalesce(sum(good) FILTER (mask & own > 0 AND mask & coalesce(earlier, 0)::INTEGER = 0), 0)::BIGINT AS good_lost,
           coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & coalesce(earlier, 0)::INTEGER = 0), 0)::BIGINT AS toxic_lost
    FROM masks, steps GROUP BY ALL)
SELECT * EXCLUDE (f), sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM figures
"""


QUERIES = {"op1_chat": op1_chat, "op2_shards": op2_shards, "op3_decontaminate": op3_decontaminate, "op4_quality": op4_quality, "op5_language": op5_language, "op6_simhash": op6_simhash, "op7_line_dedup": op7_line_dedup, "op8_bpe": op8_bpe, "op9_audio": op9_audio, "op10_suffix_dedup": op10_suffix_dedup, "op11_html_extract": op11_html_extract, "op12_centroids": op12_centroids, "op13_filter_audit": op13_filter_audit}
ORACLE_SQL: dict[str, str] = {"op7_line_dedup": OP7_SQL, "op12_centroids": OP12_SQL, "op13_filter_audit": OP13_SQL}
