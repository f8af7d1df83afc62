"""Registered queries of the numbered operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.llm import alignment, chat, contamination, hamming, language, manifest, minhash, packing, passages, pieces, sharding, topk, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_jump_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract 1 under the law ``key``."""
    placed = sharding.shard_rows(table(spark, sf_dir, "documents"), 40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op2_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and checksum of each document's ids, and whether they decode to its text."""
    return pieces.facts(pieces.encode(table(spark, sf_dir, "documents")))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.filter("vec_id % 100 = 0"))


OP4_SQL = """WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) WHERE n <= 10"""


def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "_kept.n_words", "_kept.n_removed", F.sha2("_kept.kept_text", 256).alias("kept_sha256"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.compared_with_edits(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn with its repaired role, what was done, and the text it adds to the rendered conversation."""
    return chat.repair(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "place", "role", "action", "inserted", "fragment")


def op10_simhash_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = hamming.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifest.checked(manifest.proofs(table(spark, sf_dir, "documents")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _level(nodes: str, out: str, group: str) -> str:
    """Runs of 16 nodes of a level, and the nodes of the next."""
    return f"""{out}_runs AS (SELECT {group}, p // 16 AS q, c, list(node ORDER BY p) AS nodes FROM {nodes} GROUP BY ALL),
{out} AS (SELECT {group}, q AS p, CASE WHEN c > 1 THEN sha256(array_to_string(nodes, '')) ELSE nodes[1] END AS node, (c + 15) // 16 AS c FROM {out}_runs)"""


def _way(rows: str, out: str, runs: str, group: str, level: int) -> str:
    """Rows with what stands beside their way at one level, and the digest they give there."""
    own = f"((p // {16 ** level}) % 16)"
    return f"""{out} AS (SELECT w.* REPLACE (CASE WHEN r.c > 1 THEN sides || lo || hi ELSE sides END AS sides, CASE WHEN r.c > 1 THEN sha256(lo || fold || hi) ELSE fold END AS fold)
    FROM {rows} w JOIN {runs} r ON w.{group} IS NOT DISTINCT FROM r.{group} AND r.q = w.p // {16 ** (level + 1)},
    LATERAL (SELECT array_to_string(r.nodes[1:{own}], '') AS lo, array_to_string(r.nodes[{own} + 2:16], '') AS hi))"""


def merkle_sql(levels: int = 6) -> str:
    """SQL for up to 16^levels rows of a source, and as many sources."""
    digest = lambda text: "sha256(" + " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    lower = f"translate(text, '{manifest.UPPER}', '{manifest.LOWER}')"
    crc = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ord(c)::BIGINT)),
        lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""
    steps = [f"""d AS (SELECT doc_id, source, {digest("text")} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {digest(lower)} END AS other FROM documents)""",
             """l0 AS (SELECT doc_id, source, leaf, leaf AS node, coalesce(other, leaf) AS fold, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
    count(*) OVER (PARTITION BY source) AS c FROM d)"""]
    steps += [_level(f"l{n}", f"l{n + 1}", "source") for n in range(levels)]
    steps += [f"""s0 AS (SELECT 0 AS g, source, node, node AS fold, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS p, count(*) OVER () AS c FROM l{levels})"""]
    steps += [_level(f"s{n}", f"s{n + 1}", "g") for n in range(levels)]
    steps += ["w0 AS (SELECT doc_id, source, leaf, p, fold, '' AS sides FROM l0)"]
    steps += [_way(f"w{n}", f"w{n + 1}", f"l{n + 1}_runs", "source", n) for n in range(levels)]
    steps += [f"""v0 AS (SELECT 0 AS g, doc_id, leaf, s.node AS subroot, s.p, w.fold, sides FROM w{levels} w JOIN s0 s ON w.source IS NOT DISTINCT FROM s.source)"""]
    steps += [_way(f"v{n}", f"v{n + 1}", f"s{n + 1}_runs", "g", n) for n in range(levels)]
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, leaf, subroot, s.node AS root, sha256(sides) AS proof_sha256, fold AS folded_root, fold = s.node AS verified FROM v{levels}, s{levels} s"""


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), into="found")
    return found.select(
        "doc_id", "found.n_words", "found.n_hit", F.size("found.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"), (F.col("found.n_hit") > 0).alias("contaminated"))


OP13_SQL = r"""WITH d AS (
    SELECT row_number() OVER () AS r, doc_id,
           coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
      FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS phrase
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
dw AS (SELECT r, s, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
       FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM iw) AS sizes WHERE len(w) >= k)),
hits AS (SELECT dw.r, dw.s, dw.k, iw.item_id FROM dw JOIN iw ON dw.k = iw.k AND dw.phrase = iw.phrase),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(s, s + k)) AS p FROM hits) GROUP BY r),
own AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM hits WHERE item_id IS NOT NULL GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN own USING (r)"""


QUERIES = {f.__name__: f for f in (
    op1_jump_sharding, op2_sentence_pieces, op3_best_fit_packing, op4_exact_top_k, op5_repeated_passages, op6_toxicity, op7_minhash_fingerprints, op8_language, op9_chat_repair, op10_simhash_duplicates, op11_token_alignment, op12_merkle_manifest, op13_decontamination)}
ORACLES: dict[str, str] = {"op4_exact_top_k": OP4_SQL, "op12_merkle_manifest": merkle_sql(), "op13_decontamination": OP13_SQL}
