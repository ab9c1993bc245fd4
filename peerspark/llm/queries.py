"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .bpe import bpe_round_trip
from .exact import exact_dedup
from .langid import held_out, identify, learn
from .lexical import LOWER, TERM, UPPER, ranked_search
from .minhash import near_duplicates
from .multiindex import nearest_neighbours
from .packing import best_fit_packing
from .preference import preference_segments, swapped_replies
from .quality import fit, judge
from .recompression import remove_repeats
from .registry import query, table, vocabulary
from .tokencount import token_counts
from .trie import conversation_trie
from .warc import archived_pages


@query("op1_bpe_round_trip")
def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, decoded again, with digests of both."""
    both = bpe_round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
                       F.sha2("text", 256).alias("decoded_sha256"))


@query("op2_exact_dedup", r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, sha256(norm) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
WINDOW g AS (PARTITION BY norm)
""")
def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of the whole table."""
    return exact_dedup(table(spark, sf_dir, "documents"))


@query("op10_best_fit_packing")
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return best_fit_packing(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


@query("op3_near_dedup")
def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents at 75 % of shared five-word shingles."""
    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_substring_dedup")
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without their repeated windows of 35 words."""
    cut = remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learnt from four fifths of them."""
    docs, vocab = table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")
    langs, probs = learn(docs.filter(~held_out()), vocab)
    told = identify(docs, vocab, langs, probs)
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict of every document, the classifier fitted to the quality labels."""
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


@query("op4_warc_revisits", """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
q AS (SELECT *, n >= 100 AND page_id <> min(page_id) OVER (PARTITION BY digest) AS again, min(page_id) OVER (PARTITION BY digest) AS first FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to
FROM q
""")
def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages archived and read back; payloads of responses are measured again, revisits tell from their header."""
    found = archived_pages(table(spark, sf_dir, "pages"))
    number = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1)
    whole = F.col("payload").isNotNull()
    return found.select(
        number("record_id").cast("long").alias("page_id"),
        F.when(whole, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(whole, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type", F.when(F.col("refers_to").isNotNull(), number("refers_to").cast("long")).alias("refers_to"))


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by field, the text's first line apart; a crossing token counts where most of it is."""
    import public_tokenizers
    return token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op9_preference_format", """
WITH turns AS (SELECT conv_id AS pair_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT pair_id, max(turn) AS last_turn, arg_max(coalesce(text, ''), turn) AS reply FROM turns
         WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY pair_id),
rejected AS (
  SELECT t.pair_id, t.turn, t.role, t.text FROM turns t LEFT JOIN last l ON t.pair_id = l.pair_id WHERE l.last_turn IS NULL OR t.turn < l.last_turn
  UNION ALL
  SELECT a.pair_id, a.last_turn, 'assistant', b.reply FROM last a JOIN last b ON b.pair_id = xor(a.pair_id, 1)),
both_sides AS (SELECT *, 1 AS c, 0 AS r FROM turns UNION ALL SELECT *, 0, 1 FROM rejected),
counted AS (SELECT pair_id, coalesce(turn, 9223372036854775807) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text, sum(c) AS c, sum(r) AS r
            FROM both_sides GROUP BY 1, 2, 3, 4),
cuts AS (SELECT pair_id, min(CASE WHEN c <> r THEN turn END) AS cut FROM counted GROUP BY pair_id),
placed AS (
  SELECT pair_id, turn, role, text, 'prompt' AS part, c AS n FROM counted JOIN cuts USING (pair_id) WHERE cut IS NULL OR turn < cut
  UNION ALL
  SELECT pair_id, turn, role, text, 'chosen', c FROM counted JOIN cuts USING (pair_id) WHERE turn >= cut
  UNION ALL
  SELECT pair_id, turn, role, text, 'rejected', r FROM counted JOIN cuts USING (pair_id) WHERE turn >= cut),
shown AS (SELECT pair_id, part, turn, copy, role, text, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS rendered
          FROM placed, range(1, 100) AS k(copy) WHERE copy <= n),
spans AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY pair_id, part ORDER BY turn, role, text, copy
                                                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                 + CASE WHEN part = 'prompt' THEN 0 ELSE coalesce(sum(CASE WHEN part = 'prompt' THEN length(rendered) END) OVER (PARTITION BY pair_id), 0) END AS start
          FROM shown)
SELECT pair_id, part, turn, CAST(copy AS BIGINT) AS copy, role, rendered, CAST(start AS BIGINT) AS start,
       CAST(start + length(rendered) AS BIGINT) AS "end",
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + 13 + length(role) END AS BIGINT) AS mask_start,
       CAST(CASE WHEN part <> 'prompt' AND role = 'assistant' THEN start + length(rendered) END AS BIGINT) AS mask_end
FROM spans
""")
def op9_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation against the same one with its neighbour's last reply."""
    return preference_segments(*swapped_replies(table(spark, sf_dir, "conversations")))


@query("op13_ranked_search", rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
docs AS (SELECT row_number() OVER () AS row, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT count(*) AS n_all, CAST(sum(n) AS BIGINT) AS l_all FROM docs),
items AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark),
tfs AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_all + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tfs, whole GROUP BY term, n_all),
lengths AS (SELECT row, doc_id, 10 + (90 * n * n_all) // l_all AS m FROM docs, whole),
scores AS (SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
           FROM items JOIN weights USING (term) JOIN tfs USING (term) JOIN lengths USING (row) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= 10
""")
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_prefix_trie", r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(sha256(length(role) || ':' || role || text) ORDER BY place) AS marks,
               list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY place) AS words FROM t GROUP BY conv_id),
bits AS (SELECT conv_id, flatten([[ord(c), 0, 0, 0, 0, 0, 0, 0] FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]) AS steps FROM own),
heads AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, [CAST(v AS BIGINT) FOR v IN steps]),
                                          lambda x, v: xor(xor(x, v) >> 1, 3988292384 * (xor(x, v) & 1))), 4294967295) % 4 AS h FROM bits),
rebuilt AS (
  SELECT o.conv_id, list_concat(list_slice(coalesce(b.marks, []), 1, h), list_slice(o.marks, h + 1, len(o.marks))) AS marks,
         list_concat(list_slice(coalesce(b.words, []), 1, h), list_slice(o.words, h + 1, len(o.words))) AS words
  FROM own o JOIN heads USING (conv_id) LEFT JOIN own b ON b.conv_id = o.conv_id - o.conv_id % 20),
members AS (SELECT conv_id, d, list_slice(marks, 1, d) AS path, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS last_words, len(marks) = d AS ends
            FROM (SELECT *, unnest(range(0, len(marks) + 1)) AS d FROM rebuilt)),
nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(last_words) AS saved,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
          FROM members GROUP BY path, d),
children AS (SELECT list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1),
whole AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (path)),
below AS (SELECT list_slice(path, 1, up) AS path, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves
          FROM (SELECT *, unnest(range(0, d + 1)) AS up FROM whole) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, w.ends_sha256
FROM whole w JOIN below USING (path) LEFT JOIN nodes p ON w.d > 0 AND p.path = list_slice(w.path, 1, w.d - 1)
""")
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every shared and own prefix of the rebuilt conversations."""
    return conversation_trie(table(spark, sf_dir, "conversations"))


@query("op11_nearest_neighbours", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
w AS (SELECT * FROM v WHERE len(e) = (SELECT len(e) FROM v GROUP BY len(e) ORDER BY count(*) DESC, len(e) DESC LIMIT 1)),
pairs AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) AS score FROM w a JOIN w b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 20
""")
def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors of every twentieth one."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)
