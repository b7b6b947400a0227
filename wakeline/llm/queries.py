"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wakeline.llm import chat, decontaminate, langid, licenses, manifest, mixing, nearduplicates, packing, quality, repair, sharding, substrings, warc

from wakeline.llm.text import BLANKS, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return docs.select(
        "doc_id", *[F.col(f"quality.{name}").alias(name) for name in names], "base_failed", "kept", F.array_join("broken_rules", ",").alias("broken")
    )


def op2_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "matched", "item_tokens", F.size("tiles").alias("n_tiles"))


def op3_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", (F.length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32")
    )
    placed = sharding.sharded(sharding.sharded(sized, sharding.tree_of(8)), sharding.tree_of(9), name="grown")
    digest = placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        F.col("place.shard").alias("shard"),
        F.col("grown.shard").alias("grown_shard"),
        F.col("place.region").alias("region"),
        F.col("place.rack").alias("rack"),
    )
    return sharding.numbered(digest, "shard", ["doc_id", "size", "text_crc32"], "slot")


def op4_viterbi_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.learned(docs.where("not held_out"))
    found = langid.labelled(docs.select("doc_id", "held_out", "text"), model)
    return found.select(
        "doc_id", "held_out", F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.size("language.spans").alias("n_spans")
    )


def tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def op5_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = stored(packed_digest(table(spark, sf_dir, "documents")), "pieces")
    return packing.batched(pieces)


def packed_digest(docs: DataFrame) -> DataFrame:
    return packing.packed(docs, *tokenizer()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )


def with_conflict(conversations: DataFrame) -> DataFrame:
    """The conversations and one whose texts look like another template's marks."""
    role = F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant"))
    added = conversations.sparkSession.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text")
    )
    return conversations.select("conv_id", "turn", "role", "text").unionByName(added)


def op6_bayesian_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearduplicates.grouped(table(spark, sf_dir, "documents"), nearduplicates.Settings(shingle=4))


def op7_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.read_back(chat.formatted(with_conflict(table(spark, sf_dir, "conversations"))))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = licenses.scanned(docs, licenses.document_frequencies(docs, licenses.NOTICES))
    plain = ("n_words", "n_base", "first_word", "last_word", "score")
    joined = [F.array_join(f"license.{name}", ",").alias(name) for name in ("base_labels", "labels")]
    return found.select("doc_id", *[F.col(f"license.{name}").alias(name) for name in plain], *joined)


def op9_path_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), BLANKS, " "))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """A crawl over the pages: a capture of each, and later requests that were answered 304.

    Page numbers in URLs are cut to their last digit, so that many pages share one. A fifth of
    the captures are errors. The second request of every third page carries a tag that does not
    fit, and one of seven has no tag but a date only.
    """
    n, day = F.col("page_id"), F.lit("2024-01-01 00:00:00").cast("timestamp")
    url = F.regexp_replace("url", r"/[0-9]*([0-9])([?#]|$)", "/$1$2")
    print_ = F.md5(F.coalesce(F.col("html"), F.lit("")))
    date = F.concat(F.lit("day "), (n % 28).cast("string"))

    def after(seconds) -> Column:
        return F.timestamp_micros(F.unix_micros(day) + (seconds * 1_000_000).cast("bigint"))

    def record(shift: int, kind: str, status, at, url, headers) -> Column:
        return F.struct(
            (n * 3 + shift).alias("record_id"),
            url.alias("url"),
            at.alias("at"),
            F.lit(kind).alias("kind"),
            status.cast("int").alias("status"),
            headers.alias("headers"),
            print_.alias("digest"),
        )

    tag = F.concat(F.lit('"'), F.substring(print_, 1, 16), F.lit('"'))
    text = F.lit("text/html")
    capture = F.create_map(
        F.lit("ETag"), tag, F.lit("Last-Modified"), date, F.lit("Content-Type"), text, F.lit("Content-Length"), F.length("html").cast("string")
    )
    first = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("Cache-Control"), F.lit("max-age=60"), F.lit("Content-Length"), F.lit("0"))
    second_tag = F.when(n % 3 == 0, F.lit('"other"')).otherwise(tag)
    second = F.when(n % 7 == 0, F.create_map(F.lit("Last-Modified"), date, F.lit("Age"), F.lit("1"))).otherwise(
        F.create_map(F.lit("ETag"), second_tag, F.lit("Age"), F.lit("2"))
    )
    ok = F.when(n % 5 == 4, F.lit(404)).otherwise(F.lit(200))
    records = F.array(
        record(0, "response", ok, after(n * 600), url, capture),
        record(1, "revisit", F.lit(304), after(n * 600 + 5), F.concat(url, F.lit("#part")), first),
        record(2, "revisit", F.lit(304), after(n * 600 + 90_000 * (n % 4)), url, second),
    )
    return pages.select(F.inline(records))


def op10_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolved(crawl_records(table(spark, sf_dir, "pages")))
    lines = F.transform("headers", lambda pair: F.concat(pair["name"], F.lit(": "), pair["value"]))
    return found.withColumns({"headers": F.array_join(lines, "\n"), "at": F.unix_micros("at")}).withColumnRenamed("at", "micros")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    doc_id, text = F.col("doc_id"), F.col("text")

    def leaf(text: Column) -> Column:
        return manifest.leaf_digest(doc_id, F.col("source"), F.col("lang"), F.col("n_chars"), text)

    hit = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0, F.lit(False))
    lower = F.translate(text, licenses.UPPER, licenses.LOWER)
    leaves = docs.select("doc_id", "lang", leaf(text).alias("leaf"), F.when(hit, leaf(lower)).alias("tampered"))
    found = manifest.manifest(leaves)
    proof = F.array_join(F.transform("steps", lambda step: F.concat(step["left"], step["right"])), "")
    found = found.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf"), F.col("steps")))
    return found.select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        F.sha2(proof.cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixed(table(spark, sf_dir, "documents"))
    once = found.where("copy is null or copy = 1")
    return once.select("doc_id", "size", "source_size", "target", F.col("doc_taken").alias("taken"), F.round("position", 6).alias("position"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The conversations with a fifth of their turns dropped, emptied, cut, repeated or given to the user; nulls are a space."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text = F.crc32(key.cast("binary")) % 20, F.coalesce(F.col("text"), space)
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(F.col("role"), space)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), times)).alias("again"),
    ).drop("again")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    audits, turns = repair.repaired(damaged(given))
    shas = repair.digests(turns.select("tree", "place", F.concat("role", F.lit(":"), "text").alias("line")))
    found = audits.join(shas, "tree", "left").drop("tree", "turns", "emitted").withColumnRenamed("conv_id", "id")
    all_ids = given.select("conv_id").distinct()
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return all_ids.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").select(
        "conv_id",
        *[F.coalesce(name, F.lit(0).cast("bigint")).alias(name) for name in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_greedy_tiling": op2_greedy_tiling,
        "op3_hash_tree_sharding": op3_hash_tree_sharding,
        "op4_viterbi_language": op4_viterbi_language,
        "op5_binary_packing": op5_binary_packing,
        "op6_bayesian_minhash": op6_bayesian_minhash,
        "op7_chat_round_trip": op7_chat_round_trip,
        "op8_license_scan": op8_license_scan,
        "op9_path_compaction": op9_path_compaction,
        "op10_revisit_resolution": op10_revisit_resolution,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_curriculum_mix": op12_curriculum_mix,
        "op13_conversation_repair": op13_conversation_repair,
    }


# Fixed in both engines: blanks between words.
SQL_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def quality_sql() -> str:
    stop = ", ".join(f"'{word}'" for word in sorted(set(quality.STOP_WORDS)))
    return rf"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, {SQL_WORDS} AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), grams AS (
  SELECT r, unnest(range(1, greatest(len(words) - 1, 1))) AS p, words FROM cut
), counted AS (
  SELECT r, p, count(*) OVER (PARTITION BY r, words[p], words[p + 1], words[p + 2]) AS n FROM grams
), repeats AS (
  SELECT r, count(DISTINCT p + shift) AS n_repeat_words
  FROM counted, (VALUES (0), (1), (2)) AS s(shift) WHERE n > 1 GROUP BY r
), measures AS (
  SELECT r, doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS n_stop_words,
    len(list_filter(words, lambda w: w = upper(w) AND w <> lower(w) AND length(w) > 1)) AS n_upper_words,
    len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines,
    len(list_filter(lines, lambda l: regexp_matches(l, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines
  FROM cut LEFT JOIN repeats USING (r)
), ratios AS (
  SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars,
    coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_ratio,
    coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_word_ratio,
    coalesce(n_upper_words / nullif(n_words, 0), 0) AS upper_word_ratio,
    coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
    coalesce(n_ellipsis_lines / nullif(n_lines, 0), 0) AS ellipsis_line_ratio,
    coalesce(n_bullet_lines / nullif(n_lines, 0), 0) AS bullet_line_ratio
  FROM measures
), judged AS (
  SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    concat_ws(',', {", ".join(rule_sql(rule) for rule in quality.RULES)}) AS broken
  FROM ratios
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND broken = '' AS kept, broken
FROM judged"""


def rule_sql(rule: quality.Rule) -> str:
    sides = [f"{rule.measure} < {rule.low}"] * (rule.low is not None) + [f"{rule.measure} > {rule.high}"] * (rule.high is not None)
    return f"CASE WHEN {' OR '.join(sides)} THEN '{rule.name}' END"


def chat_sql() -> str:
    marks = "|".join(f"{mark[1:]}".replace("|", r"\|").replace("]", r"\]") for mark in chat.CHAT.marks if mark[0] == "<")
    brackets = "|".join(f"{mark[1:]}".replace("]", r"\]") for mark in chat.CHAT.marks if mark[0] == "[")
    fixed = sum(map(len, (chat.CHAT.opening, chat.CHAT.separator, chat.CHAT.closing)))

    def length(column: str) -> str:
        return (
            rf"length(regexp_replace(regexp_replace({column}, '<(\\*(?:{marks}))', '<\\\1', 'g'), "
            rf"'\[(\\*(?:{brackets}))', '[\\\1', 'g'))"
        )

    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({fixed} + {length('role')} + {length('text')}) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id"""


def tree_sql(shards: int) -> dict[str, str]:
    """Region, rack and shard of a key, each as an SQL expression over the ones before."""
    tree = sharding.tree_of(shards)

    def winner(weights: dict, level: str, quote: str) -> str:
        draws = [
            "{'draw': -ln((CAST('0x' || substr(md5('"
            + f"{level}:{child}/' || key), 1, 13) AS BIGINT) + 0.5) / CAST({2**52} AS DOUBLE)) / {weight}, 'child': {quote}{child}{quote}}}"
            for child, weight in weights.items()
        ]
        return f"list_min([{', '.join(draws)}]).child"

    def choice(column: str, branches: dict) -> str:
        return f"CASE {column} {' '.join(f"WHEN '{name}' THEN {value}" for name, value in branches.items())} END"

    racks = {rack: sum(own.values()) for group in tree.values() for rack, own in group.items()}
    region = winner({name: sum(racks[rack] for rack in group) for name, group in tree.items()}, "region", "'")
    rack = choice("region", {name: winner({rack: racks[rack] for rack in group}, "rack", "'") for name, group in tree.items()})
    shard = choice("rack", {name: winner(own, "shard", "") for group in tree.values() for name, own in group.items()})
    return {"region": region, "rack": rack, "shard": shard}


def shard_sql() -> str:
    """The checksum runs byte by byte over a table of 256 remainders, which is computed first."""
    small, large = tree_sql(8), tree_sql(9)
    bits = " ".join(["SELECT i, 0 AS step, i AS value FROM range(256) AS r(i)"])
    return f"""
WITH RECURSIVE steps AS (
  {bits}
  UNION ALL SELECT i, step + 1, CASE WHEN value % 2 = 1 THEN xor(value // 2, 3988292384) ELSE value // 2 END FROM steps WHERE step < 8
), remainders AS (
  SELECT list(CAST(value AS BIGINT) ORDER BY i) AS t FROM steps WHERE step = 8
), texts AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS code FROM documents
), bytes AS (
  SELECT r, doc_id, list_transform(range(length(code) // 2), lambda i: CAST('0x' || substr(code, CAST(2 * i + 1 AS INTEGER), 2) AS BIGINT)) AS b FROM texts
), sized AS (
  SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size, coalesce(CAST(doc_id AS VARCHAR), 'null') AS key,
    xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256)), 4294967295) AS text_crc32
  FROM bytes, remainders
), regions AS (SELECT *, {small['region']} AS region FROM sized
), racks AS (SELECT *, {small['rack']} AS rack FROM regions
), shards AS (SELECT *, {small['shard']} AS shard FROM racks
), grown1 AS (SELECT doc_id, size, text_crc32, region AS region8, rack AS rack8, shard AS shard8, key, {large['region']} AS region
  FROM (SELECT doc_id, size, text_crc32, key, region AS region8, rack AS rack8, shard FROM shards) AS s(doc_id, size, text_crc32, key, region, rack, shard)
), grown2 AS (SELECT *, {large['rack']} AS rack FROM grown1
), grown3 AS (SELECT *, {large['shard']} AS shard FROM grown2)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard8 AS INTEGER) AS shard, CAST(shard AS INTEGER) AS grown_shard,
  region8 AS region, rack8 AS rack, row_number() OVER (PARTITION BY shard8 ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot
FROM grown3"""


SQL_BYTES = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
SQL_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def groups_sql(size: int = 4, percent: int = 80) -> str:
    return f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, {SQL_BYTES.format(text=SQL_LOWER)} AS words FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < {size} THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - {size} + 2), lambda p: array_to_string(words[p:p + {size} - 1], ' '))) END AS shingles
  FROM cut
), members AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM members a JOIN members b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reached AS (
  SELECT doc_id, doc_id AS other FROM sets
  UNION SELECT r.doc_id, l.v FROM reached r JOIN both_ways l ON r.other = l.u
), least AS (
  SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, CAST(len(shingles) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)"""


def spans_sql(window: int = 20) -> str:
    return f"""
WITH cut AS (
  SELECT doc_id, {SQL_WORDS} AS words FROM documents
), windows AS (
  SELECT doc_id, p, array_to_string(words[p:p + {window} - 1], ' ') AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - {window} + 2)) AS p FROM cut WHERE len(words) >= {window})
), placed AS (
  SELECT doc_id, p, row_number() OVER (PARTITION BY gram ORDER BY doc_id, p) AS place FROM windows
), removed AS (
  SELECT DISTINCT doc_id, p + step AS p FROM placed, range({window}) AS s(step) WHERE place > 1
), numbered AS (
  SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM cut
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM numbered ANTI JOIN removed USING (doc_id, p) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (doc_id)"""


def revisit_sql() -> str:
    refused = ", ".join(f"'{name}'" for name in warc.NOT_REPLACED)
    day = 1_704_067_200
    return rf"""
WITH pages_cut AS (
  SELECT page_id AS n, regexp_replace(url, '/[0-9]*([0-9])([?#]|$)', '/\1\2') AS url, md5(coalesce(html, '')) AS digest,
    'day ' || CAST(page_id % 28 AS VARCHAR) AS date, CAST(length(html) AS VARCHAR) AS size FROM pages
), tagged AS (
  SELECT *, '"' || substr(digest, 1, 16) || '"' AS tag FROM pages_cut
), records AS (
  SELECT n * 3 AS record_id, url, n * 600 AS s, 'full' AS kind, n % 5 <> 4 AS counts,
    MAP {{'etag': tag, 'last-modified': date, 'content-type': 'text/html', 'content-length': size}} AS h, digest FROM tagged
  UNION ALL SELECT n * 3 + 1, url || '#part', n * 600 + 5, 'revisit', TRUE,
    MAP {{'etag': 'W/' || tag, 'cache-control': 'max-age=60', 'content-length': '0'}}, digest FROM tagged
  UNION ALL SELECT n * 3 + 2, url, n * 600 + 90000 * (n % 4), 'revisit', TRUE,
    CASE WHEN n % 7 = 0 THEN MAP {{'last-modified': date, 'age': '1'}}
         ELSE MAP {{'etag': CASE WHEN n % 3 = 0 THEN '"other"' ELSE tag END, 'age': '2'}} END, digest FROM tagged
), parts AS (
  SELECT *, ({day} + s) * 1000000 AS micros,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^(www|m)\.', ''), ':(80|443)$', '') AS host,
    regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path,
    list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'),
      lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)'))) AS params
  FROM records
), canonical AS (
  SELECT *, host || CASE WHEN path = '' THEN '/' ELSE path END
    || CASE WHEN len(params) = 0 THEN '' ELSE '?' || array_to_string(params, '&') END AS canonical_url FROM parts
), joined AS (
  SELECT v.record_id, v.canonical_url, v.micros, v.h, f.record_id AS response_id, f.h AS fh, f.digest AS fd,
    row_number() OVER (PARTITION BY v.record_id ORDER BY f.micros DESC, f.record_id DESC) AS place
  FROM canonical v LEFT JOIN canonical f
    ON f.canonical_url = v.canonical_url AND f.kind = 'full' AND f.counts AND f.micros < v.micros
  WHERE v.kind = 'revisit'
), tags AS (
  SELECT *, regexp_replace(fh['etag'], '^W/', '') AS ft, regexp_replace(h['etag'], '^W/', '') AS vt FROM joined WHERE place = 1
), checked AS (
  SELECT *, CASE WHEN response_id IS NULL THEN 'no response'
    WHEN ft IS NOT NULL AND vt IS NOT NULL THEN CASE WHEN ft = vt THEN 'etag' ELSE 'mismatch' END
    WHEN fh['last-modified'] IS NOT NULL AND h['last-modified'] IS NOT NULL
      THEN CASE WHEN fh['last-modified'] = h['last-modified'] THEN 'last-modified' ELSE 'mismatch' END
    ELSE 'unvalidated' END AS validation FROM tags
), entries AS (
  SELECT *, list_filter(map_entries(h), lambda e: e.key NOT IN ({refused})) AS new FROM checked
)
SELECT record_id, canonical_url, CAST(micros AS BIGINT) AS micros, response_id, validation,
  CASE WHEN validation IN ('etag', 'last-modified') THEN array_to_string(list_sort(list_transform(list_concat(
    list_filter(map_entries(fh), lambda e: NOT list_contains(list_transform(new, lambda x: x.key), e.key)), new),
    lambda e: e.key || ': ' || e.value)), chr(10)) END AS headers,
  CASE WHEN validation IN ('etag', 'last-modified') THEN fd END AS digest
FROM entries"""


def license_sql() -> str:
    def quoted(words: list[str]) -> str:
        return "[" + ", ".join(f"'{word}'" for word in words) + "]"

    notices = ",\n    ".join(
        f"({at}, '{n.label}', {quoted(n.words)}, {quoted(n.key.split())}, {n.key_at})" for at, n in enumerate(licenses.NOTICES)
    )
    phrases = ", ".join(f"({quoted(phrase.split())}, '{label}')" for phrase, label in licenses.PHRASES.items())
    return rf"""
WITH notices(notice, label, wording, key, key_at) AS (
  VALUES {notices}
), phrases(phrase, label) AS (
  VALUES {phrases}
), texts AS (
  SELECT row_number() OVER () AS r, doc_id,
    list_filter(regexp_split_to_array({SQL_LOWER}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS words
  FROM documents
), tokens AS (
  SELECT r, unnest(words) AS w, unnest(range(len(words))) AS p FROM texts
), template_words AS (
  SELECT notice, unnest(wording) AS w, unnest(range(len(wording))) AS spot FROM notices
), frequencies AS (
  SELECT w, count(DISTINCT r) AS texts FROM (SELECT DISTINCT w FROM template_words) LEFT JOIN tokens USING (w) GROUP BY w
), rarest AS (
  SELECT notice, w FROM (SELECT DISTINCT notice, w FROM template_words) JOIN frequencies USING (w)
  QUALIFY row_number() OVER (PARTITION BY notice ORDER BY texts, w) <= {licenses.RARE}
), placed AS (
  SELECT r, notice, p - spot AS start
  FROM tokens JOIN (template_words JOIN rarest USING (notice, w)) USING (w) GROUP BY r, notice, start HAVING count(*) >= 2
), matches AS (
  SELECT r, label, CAST(len(list_filter(range(len(wording)), lambda i: start + i >= 0 AND words[start + i + 1] = wording[i + 1])) AS DOUBLE)
    / len(wording) AS agreement
  FROM placed JOIN notices USING (notice) JOIN texts USING (r)
  WHERE start + key_at >= 0 AND words[start + key_at + 1:start + key_at + len(key)] = key AND agreement >= {licenses.MIN_SHARE}
), places AS (
  SELECT r, label, p FROM tokens JOIN phrases ON w = phrase[1] JOIN texts USING (r) WHERE words[p + 1:p + len(phrase)] = phrase
), base AS (
  SELECT r, count(*) AS n, min(p) AS first_word, max(p) AS last_word FROM places GROUP BY r
), labelled AS (
  SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT r, label, TRUE AS is_base FROM places UNION ALL SELECT r, label, FALSE FROM matches) GROUP BY r
), scores AS (
  SELECT r, max(agreement) AS score FROM matches GROUP BY r
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM texts LEFT JOIN base USING (r) LEFT JOIN labelled USING (r) LEFT JOIN scores USING (r)"""


SQL_REMAINDERS = """steps AS (
  SELECT i, 0 AS step, i AS value FROM range(256) AS r(i)
  UNION ALL SELECT i, step + 1, CASE WHEN value % 2 = 1 THEN xor(value // 2, 3988292384) ELSE value // 2 END FROM steps WHERE step < 8
), remainders AS (
  SELECT list(CAST(value AS BIGINT) ORDER BY i) AS t FROM steps WHERE step = 8
)"""


def crc32_sql(text: str) -> str:
    """The unsigned checksum of a short text of ASCII characters; ``t`` is the table of ``SQL_REMAINDERS``."""
    codes = f"list_transform(string_split({text}, ''), lambda c: CAST(ascii(c) AS BIGINT))"
    return (
        f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), "
        "lambda c, x: xor(t[xor(c, x) % 256 + 1], c // 256)), 4294967295)"
    )


def manifest_sql(arity: int = 8) -> str:
    names = ("source", "lang", "n_chars")

    def leaf(text: str) -> str:
        values = [f"CAST({name} AS VARCHAR)" for name in ("doc_id", *names)] + [text]
        return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE {SQL_REMAINDERS}, leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, {leaf('text')} AS leaf,
    CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS start
  FROM documents, remainders
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS num FROM leaves
), nodes AS (
  SELECT tree, 0 AS level, num, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, any_value(level) + 1, num // {arity}, sha256(string_agg(digest, '' ORDER BY num)), (any_value(n) + {arity - 1}) // {arity}
  FROM nodes WHERE n > 1 GROUP BY tree, num // {arity}
), subroots AS (
  SELECT tree, level, digest, row_number() OVER (ORDER BY encode(tree)) - 1 AS place FROM nodes WHERE n = 1
), upper_nodes AS (
  SELECT 0 AS level, place AS num, digest, count(*) OVER () AS n FROM subroots
  UNION ALL
  SELECT any_value(level) + 1, num // {arity}, sha256(string_agg(digest, '' ORDER BY num)), (any_value(n) + {arity - 1}) // {arity}
  FROM upper_nodes WHERE n > 1 GROUP BY num // {arity}
), ladder AS (
  SELECT r, p.tree AS tree, n.level AS step, n.num AS num, n.num % {arity} AS slot, sib.num AS sib, sib.digest AS digest
  FROM placed p JOIN nodes n ON n.tree = p.tree AND n.num = p.num // CAST(pow({arity}, n.level) AS BIGINT) AND n.n > 1
  LEFT JOIN nodes sib ON sib.tree = n.tree AND sib.level = n.level AND sib.num // {arity} = n.num // {arity} AND sib.num <> n.num
  UNION ALL
  SELECT r, p.tree, 100 + n.level, n.num, n.num % {arity}, sib.num, sib.digest
  FROM placed p JOIN subroots s ON s.tree = p.tree
  JOIN upper_nodes n ON n.num = s.place // CAST(pow({arity}, n.level) AS BIGINT) AND n.n > 1
  LEFT JOIN upper_nodes sib ON sib.level = n.level AND sib.num // {arity} = n.num // {arity} AND sib.num <> n.num
), rungs AS (
  SELECT r, step, coalesce(string_agg(digest, '' ORDER BY sib) FILTER (sib < num), '') AS lefts,
    coalesce(string_agg(digest, '' ORDER BY sib) FILTER (sib > num), '') AS rights,
    row_number() OVER (PARTITION BY r ORDER BY step) AS place FROM ladder GROUP BY r, step
), climb AS (
  SELECT r, 0 AS place, start AS digest FROM placed
  UNION ALL
  SELECT c.r, g.place, sha256(lefts || c.digest || rights) FROM climb c JOIN rungs g ON g.r = c.r AND g.place = c.place + 1
), folded AS (
  SELECT r, arg_max(digest, place) AS folded_root FROM climb GROUP BY r
), proofs AS (
  SELECT r, sha256(string_agg(lefts || rights, '' ORDER BY place)) AS proof_sha256 FROM rungs GROUP BY r
)
SELECT doc_id, leaf, s.digest AS subroot, u.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root,
  folded_root = u.digest AS verified
FROM placed JOIN subroots s USING (tree) JOIN folded USING (r) LEFT JOIN proofs USING (r)
JOIN (SELECT digest FROM upper_nodes WHERE n = 1) u ON TRUE"""


def mixing_sql() -> str:
    curriculum = mixing.CURRICULUM
    turns = len(curriculum.schedules)
    weights = ", ".join(f"CAST({weight} AS DOUBLE)" for weight in curriculum.weights)

    def number(value: float) -> str:
        return f"CAST({value!r} AS DOUBLE)"

    def position(schedule: tuple[float, ...]) -> str:
        reached, times, cases = curriculum.integrals(schedule), curriculum.times, []
        for at in range(len(times) - 1):
            rest = f"greatest(middle * {number(reached[-1])} - {number(reached[at])}, 0)"
            slope = (schedule[at + 1] - schedule[at]) / (times[at + 1] - times[at])
            root = f"sqrt(greatest({number(schedule[at] ** 2)} + {number(2.0 * slope)} * {rest}, 0))"
            cases.append(f"WHEN middle * {number(reached[-1])} <= {number(reached[at + 1])} THEN {number(times[at])} + 2 * {rest} / ({number(schedule[at])} + {root})")
        return f"CASE {' '.join(cases)} ELSE {number(times[-1])} END"

    positions = " ".join(f"WHEN {turn} THEN {position(schedule)}" for turn, schedule in enumerate(curriculum.schedules))
    return f"""
WITH RECURSIVE sized AS (
  SELECT row_number() OVER () AS r, doc_id, source, CAST(len({SQL_WORDS}) AS BIGINT) AS size,
    md5('{curriculum.seed}/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || coalesce(text, '')) AS draw FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % {turns} AS turn
  FROM sized GROUP BY source
), weighed AS (
  SELECT *, [{weights}][turn + 1] AS weight, CAST({curriculum.repeats} AS DOUBLE) * source_size AS most FROM sources
), levels AS (
  SELECT 0 AS step, CAST({curriculum.share} AS DOUBLE) * sum(source_size) AS goal, CAST(NULL AS DOUBLE) AS before,
    CAST({curriculum.share} AS DOUBLE) * sum(source_size) / sum(weight) AS level FROM weighed
  UNION ALL
  SELECT step + 1, goal, level, (SELECT (l.goal - coalesce(sum(most) FILTER (most <= l.level * weight), 0))
    / sum(weight) FILTER (most > l.level * weight) FROM weighed) FROM levels l WHERE level IS NOT NULL AND (before IS NULL OR level <> before) AND step < 1000
), targets AS (
  SELECT w.*, coalesce(least(most, weight * (SELECT arg_max(level, step) FROM levels)), most) AS target FROM weighed w
), placed AS (
  SELECT s.r, s.doc_id, s.size, t.source_size, t.target, t.turn, floor(t.target + 0.5) AS demand,
    sum(size) OVER (PARTITION BY t.source ORDER BY draw, doc_id NULLS FIRST, size, s.r) - size AS begins
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), copies AS (
  SELECT *, greatest(0, least(size, demand - (begins + c * source_size))) AS part, begins + c * source_size AS at_word
  FROM placed, range({curriculum.repeats}) AS copies(c)
), middles AS (
  SELECT *, (at_word + part / 2.0) / demand AS middle FROM copies
)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
  CAST(sum(part) AS BIGINT) AS taken, round(max(CASE turn {positions} END) FILTER (c = 0 AND part > 0), 6) AS position
FROM middles GROUP BY r"""


def repair_sql() -> str:
    """Turn by turn from the end for the costs, then edit by edit from the start."""
    final = ", ".join(map(str, repair.END))
    blank, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"

    def row_cost(state: int) -> str:
        after = repair.NEXT[state]
        keeps = {0: "CASE symbol WHEN 'u' THEN v[3] WHEN 's' THEN v[2] END", 1: "CASE symbol WHEN 'u' THEN v[3] END"}
        kept = keeps.get(state, f"CASE symbol WHEN '{'a' if state == 2 else 'u'}' THEN v[{after + 1}] END")
        return f"least(2 + v[{state + 1}], CASE WHEN NOT gone THEN least(extra + coalesce({kept}, 1000000000000), extra + 1 + v[{after + 1}]) ELSE 1000000000000 END)"

    costs = ", ".join(f"{row_cost(state)} AS c{state}" for state in range(4))
    return rf"""
WITH RECURSIVE {SQL_REMAINDERS}, keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind
  FROM conversations, remainders
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, range(2) AS copies(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)
), told AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS cid,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen,
    regexp_extract(text, '({word}){blank}*$', 1) AS ending
  FROM damaged
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, encode(role), encode(text), seen) AS i FROM told
), marked AS (
  SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    role[1] AS symbol, lag(role[1]) OVER (PARTITION BY cid ORDER BY i) AS ahead FROM placed
), rows_of AS (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN {repair.TRUNCATED} ELSE 0 END AS extra FROM marked
), counts AS (
  SELECT cid, any_value(conv_id) AS conv_id, CAST(max(i) AS BIGINT) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (ahead || symbol NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_of GROUP BY cid
), back AS (
  SELECT cid, n AS i, CAST([{final}] AS BIGINT[]) AS v FROM counts
  UNION ALL
  SELECT cid, i - 1, CAST([least(c0, 5 + c2, 10 + c3), least(c1, 5 + c2, 10 + c3), least(c2, 5 + c3), least(c3, 5 + c2)] AS BIGINT[])
  FROM (SELECT b.cid, b.i, {costs} FROM back b JOIN rows_of r ON r.cid = b.cid AND r.i = b.i)
), forth AS (
  SELECT cid, 0 AS step, CAST(0 AS BIGINT) AS i, 0 AS state, '' AS audit, '' AS lines, 0 AS out FROM counts
  UNION ALL
  SELECT cid, step + 1, CASE WHEN letter = 'I' THEN i ELSE i + 1 END,
    CASE WHEN letter = 'D' THEN state WHEN letter = 'K' AND symbol = 's' THEN 1 ELSE after END, audit || letter,
    CASE WHEN letter = 'D' THEN lines ELSE lines || CASE WHEN out > 0 THEN chr(10) ELSE '' END
      || CASE WHEN letter = 'K' THEN role WHEN after = 2 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END END,
    CASE WHEN letter = 'D' THEN out ELSE out + 1 END
  FROM (
    SELECT *, CASE WHEN u IS NOT NULL AND 2 + u[state + 1] = now THEN 'D' WHEN 5 + v[after + 1] = now THEN 'I'
      WHEN NOT gone AND extra + u[CASE WHEN symbol = 's' THEN 2 ELSE after + 1 END] = now
        AND ((symbol = 's' AND state = 0) OR symbol = CASE after WHEN 2 THEN 'u' ELSE 'a' END) THEN 'K'
      WHEN NOT gone AND 1 + extra + u[after + 1] = now THEN 'R' END AS letter
    FROM (
      SELECT f.*, CASE f.state WHEN 2 THEN 3 ELSE 2 END AS after, b.v, c.v AS u, b.v[f.state + 1] AS now, r.symbol, r.gone, r.extra, r.role, r.text
      FROM forth f JOIN back b ON b.cid = f.cid AND b.i = f.i LEFT JOIN back c ON c.cid = f.cid AND c.i = f.i + 1
      LEFT JOIN rows_of r ON r.cid = f.cid AND r.i = f.i + 1
    )
  ) WHERE letter IS NOT NULL
), last AS (
  SELECT cid, max_by(audit, step) AS audit, max_by(lines, step) AS lines FROM forth GROUP BY cid
), repaired AS (
  SELECT counts.*, audit, sha256(lines) AS sha, v[1] AS cost FROM counts JOIN last USING (cid) JOIN back ON back.cid = counts.cid AND back.i = 0
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality_sql(),
        "op3_hash_tree_sharding": shard_sql(),
        "op6_bayesian_minhash": groups_sql(),
        "op7_chat_round_trip": chat_sql(),
        "op8_license_scan": license_sql(),
        "op9_path_compaction": spans_sql(),
        "op10_revisit_resolution": revisit_sql(),
        "op11_merkle_manifest": manifest_sql(),
        "op12_curriculum_mix": mixing_sql(),
        "op13_conversation_repair": repair_sql(),
    }
