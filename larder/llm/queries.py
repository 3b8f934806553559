"""The corpus operators as checked queries over the whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import benchmark, chat, jaccard, licences, merkle, mixing, negatives, pii, quality, repeats, rules, sharding, site_lines
from larder.llm.shared import table

PROBE = "</s>[INST] ok [/INST]"
SHARDS = 40


def fold_of(doc_id: str = "doc_id"):
    """Learning fold of a document: 1 is held out."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(3))


def op1_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations and one whose texts are control strings, read back from the formatted output."""
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    said = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    read = chat.format_chats(said).select(
        "conv_id",
        "formatted",
        chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_runs")).alias("loss"),
    )
    joined = read.select("*", F.array_join("loss", "").alias("loss_text"))
    return joined.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op2_licence_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licences.scan(table(spark, folder, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, folder, "documents"))


def op4_source_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"))


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, folder, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return benchmark.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return site_lines.drop_site_lines(table(spark, folder, "pages"))


def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.train(docs, table(spark, folder, "labels"), learnable=fold_of() != 1)
    scored = quality.score(docs, model)
    return scored.select("doc_id", (fold_of() == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    statistics = rules.stage(rules.text_statistics(table(spark, folder, "documents")), "rules-statistics")
    found = rules.learn_from(statistics, table(spark, folder, "labels"), learnable=fold_of() != 1)
    return rules.judge(statistics, found).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(
        "doc_id", "text", sharding.row_size("text").alias("size"), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32")
    )
    return sharding.shard_by_bytes(docs, SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op11_pii(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digest of the plain spans, and all spans, of every text."""
    found = pii.with_spans(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    return found.select(
        "doc_id",
        *[pii.count_of(base, kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.written(base), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
    )


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs of all rows; where 5 divides the id's checksum, the text is presented in lower case."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    proved = merkle.manifest(table(spark, folder, "documents"), shown={"text": lower}, altered=altered)
    return proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth row; every seventh row first takes the next label."""
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows.withColumn("label", label), anchors=F.col("id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_licence_scan,
        op3_ngram_jaccard_join,
        op4_source_mixing,
        op5_substring_dedup,
        op6_benchmark_decontamination,
        op7_line_dedup,
        op8_quality_classifier,
        op9_quality_rules,
        op10_sharding,
        op11_pii,
        op12_merkle_manifest,
        op13_hard_negatives,
    )
}

_CHAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), numbered AS (
  SELECT *, row_number() OVER w AS nr, coalesce(lag(role) OVER w <> role, true) AS begins
  FROM said WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), measured AS (
  SELECT *,
    length(regexp_replace(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|<?/?SYS>>)', '##\1', 'g'), '\[(/?INST\])', '##\1', 'g')) AS n_text,
    length(replace(regexp_replace(regexp_replace(replace(role, '\', '\\'), '<(\||/?s>|<?/?SYS>>)', '##\1', 'g'), '\[(/?INST\])', '##\1', 'g'),
                   '|', '##')) AS n_role
  FROM numbered
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY nr)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY nr) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(n_text + CASE WHEN begins THEN 4 + n_role + 4 ELSE 5 END))::BIGINT AS formatted_chars
FROM measured GROUP BY conv_id
"""

_JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i : array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b USING (shingle) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)
), reach(node, seen) AS (
  SELECT DISTINCT a, a FROM link UNION SELECT r.node, l.b FROM reach r JOIN link l ON l.a = r.seen
), least_ AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component_id, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN least_ ON node = w.doc_id
"""

_MIXING = r"""
WITH RECURSIVE counted AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
sums AS (SELECT sum(pow(n, 0.5)) AS all_weight, sum(n) AS all_rows FROM counted),
rated AS (SELECT source, pow(n, 0.5) / all_weight * all_rows / n AS mean FROM counted, sums),
parted AS (SELECT source, greatest(ceil(mean / 32.0), 1)::INT AS parts, mean / greatest(ceil(mean / 32.0), 1) AS mean FROM rated),
steps(source, parts, mean, k, p, c) AS (
  SELECT source, parts, mean, 0, exp(-mean), exp(-mean) FROM parted
  UNION ALL SELECT source, parts, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM steps WHERE k < 128
),
known AS (
  SELECT *, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS id,
    row_number() OVER (PARTITION BY coalesce(doc_id::VARCHAR, ''), coalesce(text, '')) - 1 AS number
  FROM documents
),
drawn AS (
  SELECT d.*, x.parts, ('0x' || substr(md5('17:' || id || ':' || number || ':' || part), 1, 13))::BIGINT / 4503599627370496.0 AS u
  FROM known d JOIN parted x ON d.source IS NOT DISTINCT FROM x.source, unnest(range(1, x.parts + 1)) AS p(part)
),
times AS (
  SELECT doc_id, text, lang, d.source, n_chars, id, number, count(s.k) AS n
  FROM drawn d LEFT JOIN steps s ON d.source IS NOT DISTINCT FROM s.source AND s.c <= d.u GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, copy, md5('order 17:' || id || ':' || number || ':' || copy) AS shuffle_key
FROM times, unnest(range(1, n + 1)) AS c(copy)
"""

_REPEATS = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), heads AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS head FROM w, unnest(range(1, len(words) - 18)) AS r(i)
), again AS (
  SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY head ORDER BY doc_id, i) AS k FROM heads) WHERE k > 1
), gone AS (SELECT DISTINCT doc_id, i + j AS i FROM again, range(0, 20) AS r(j)),
kept AS (
  SELECT w.doc_id, count(*) AS n, string_agg(words[u.i], ' ' ORDER BY u.i) AS kept
  FROM w, unnest(range(1, len(words) + 1)) AS u(i) ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = u.i GROUP BY w.doc_id
)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

_LINES = rf"""
WITH host AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(list_transform(regexp_split_to_array(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:{site_lines.BLOCKS})\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '\n+'), lambda x : trim(x)), lambda x : x <> '') AS lines
  FROM pages
), totals AS (SELECT host, count(*) AS pages FROM host GROUP BY host),
seen AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM host) GROUP BY ALL),
common AS (SELECT host, list(line) AS common FROM seen JOIN totals USING (host) WHERE n >= 2 AND n > 0.3 * pages GROUP BY host),
cut AS (
  SELECT page_id, host, lines, list_filter(lines, lambda x : NOT list_contains(coalesce(common, []), x)) AS kept
  FROM host LEFT JOIN common USING (host)
)
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM cut
"""

_SHARDING = r"""
WITH RECURSIVE step(b, k, c) AS (
  SELECT b, 0, b FROM range(0, 256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
known AS (
  SELECT *, md5(coalesce(doc_id::VARCHAR, '') || ':' || text) AS digest, row_number() OVER (PARTITION BY coalesce(doc_id::VARCHAR, ''), text) - 1 AS number FROM d
),
keyed AS (
  SELECT doc_id, strlen(text) + 16 AS size, substr(CASE WHEN number = 0 THEN digest ELSE md5(digest || ':' || number) END, 1, 15) AS k,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        string_split(regexp_replace(hex(encode(text)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda h : ('0x' || h)::BIGINT)),
      lambda c, x : xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS text_crc32
  FROM known, crc
), placed AS (
  SELECT *, ((sum(size) OVER (ORDER BY k RANGE UNBOUNDED PRECEDING) - sum(size) OVER (PARTITION BY k)) * 40 // sum(size) OVER ())::INT AS shard
  FROM keyed
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k) - 1 AS slot, NULL::INT AS grown_shard
FROM placed
"""

_MERKLE = r"""
WITH RECURSIVE step(b, k, c) AS (
  SELECT b, 0, b FROM range(0, 256) r(b)
  UNION ALL SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8
), crc AS (SELECT list(c ORDER BY b) AS t FROM step WHERE k = 8),
written AS (
  SELECT doc_id, source, text,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    coalesce(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
        string_split(regexp_replace(hex(encode(doc_id::VARCHAR)), '(..)', '\1 ', 'g'), ' ')[:-2], lambda h : ('0x' || h)::BIGINT)),
      lambda c, x : xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 5 = 0, false) AS altered
  FROM documents, crc
), hashed AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    CASE WHEN altered THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) END AS other
  FROM written
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
    dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, count(*) OVER (PARTITION BY source) AS n
  FROM hashed
), nodes(tree, lvl, pos, n, node) AS (
  SELECT tree, 0, pos, n, leaf FROM placed
  UNION ALL SELECT tree, lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, lvl, pos // 16, n
), subs AS MATERIALIZED (SELECT tree, node AS subroot FROM nodes WHERE n = 1),
uppers(lvl, pos, n, node) AS (
  SELECT 0, tree, (SELECT count(*) FROM subs), subroot FROM subs
  UNION ALL SELECT lvl + 1, pos // 16, (n + 15) // 16, sha256(string_agg(node, '' ORDER BY pos)) FROM uppers WHERE n > 1 GROUP BY lvl, pos // 16, n
), sides AS (
  SELECT a.tree, a.lvl, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') || '|'
    || coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS side
  FROM nodes a JOIN nodes b ON a.tree = b.tree AND a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL
), over_sides AS (
  SELECT a.lvl, a.pos, coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') || '|'
    || coalesce(string_agg(b.node, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS side
  FROM uppers a JOIN uppers b ON a.lvl = b.lvl AND a.pos // 16 = b.pos // 16 WHERE a.n > 1 GROUP BY ALL
), way AS (
  SELECT p.tree, p.pos, list(s.side ORDER BY s.lvl) AS sides
  FROM placed p JOIN sides s ON s.tree = p.tree AND s.pos = p.pos // (16 ** s.lvl)::BIGINT GROUP BY ALL
), over_way AS (
  SELECT u.tree, list(s.side ORDER BY s.lvl) AS sides
  FROM subs u JOIN over_sides s ON s.pos = u.tree // (16 ** s.lvl)::BIGINT GROUP BY ALL
), whole AS (
  SELECT p.doc_id, p.leaf, subroot, (SELECT node FROM uppers WHERE n = 1) AS root, coalesce(other, leaf) AS shown,
    coalesce(way.sides, []) || coalesce(over_way.sides, []) AS sides
  FROM placed p JOIN subs USING (tree) LEFT JOIN way USING (tree, pos) LEFT JOIN over_way USING (tree)
), folded AS (
  SELECT *, list_reduce(list_prepend(shown, sides), lambda h, s : sha256(split_part(s, '|', 1) || h || split_part(s, '|', 2))) AS folded_root FROM whole
)
SELECT doc_id, leaf, subroot, root, sha256(replace(array_to_string(sides, ''), '|', '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded
"""

_NEGATIVES = r"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x : floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x : x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5),
n AS (
  SELECT p.anchor, p.other AS positive, p.score AS positive_score, s.other AS negative, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor AS anchor_id, positive AS positive_id, rank::INT AS rank, negative AS negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

ORACLE_SQL = {
    "op1_chat_formatting": _CHAT,
    "op3_ngram_jaccard_join": _JACCARD,
    "op4_source_mixing": _MIXING,
    "op5_substring_dedup": _REPEATS,
    "op7_line_dedup": _LINES,
    "op10_sharding": _SHARDING,
    "op12_merkle_manifest": _MERKLE,
    "op13_hard_negatives": _NEGATIVES,
}
