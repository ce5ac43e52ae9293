"""The thin queries over the dealt operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_path
from .byte_bpe import decode_ids, encode_texts
from .chat import format_conversations, read_back
from .decontamination import contamination
from .exact_dedup import exact_duplicates
from .fill_in_middle import fill_in_middle, restore_texts
from .jaccard_join import near_duplicate_groups
from .language_id import fit_languages, predict_language
from .lexical_search import rank_documents
from .line_dedup import remove_repeated_chunks, remove_repeated_runs
from .packing import pack_documents
from .substring_dedup import remove_repeated_windows
from .token_output import read_positions, write_training_order
from .toxicity import fit_toxicity, score_toxicity


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeated_windows(_read(spark, folder, "documents").select("doc_id", "text"))
    return cut.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def op2_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


#: Conversation -7 of the chat query: both sides say what other templates read as control.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def op3_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = _read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame(
        [(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)],
        "conv_id bigint, turn bigint, role string, text string",
    )
    return read_back(format_conversations(turns.unionByName(planted)))


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_documents(_read(spark, folder, "documents"))
    return packed.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeated_chunks(_read(spark, folder, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_line_runs(spark: SparkSession, folder: str) -> DataFrame:
    cut = remove_repeated_runs(_read(spark, folder, "documents"))
    return cut.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def _fold(folds: int) -> Column:
    """Fold of a document; a null id is in none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(_fold(5) == 0, F.lit(True))
    model = fit_languages(docs.filter(~held_out))
    named = predict_language(docs.select("doc_id", "text"), model)
    return named.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(_read(spark, folder, "documents"))


def op8_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(_read(spark, folder, "documents"))


def op9_token_output(spark: SparkSession, folder: str) -> DataFrame:
    path = new_path(spark, "training-order")
    write_training_order(_read(spark, folder, "documents"), path)
    return read_positions(spark, path).select("position", "shard", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _read(spark, folder, "documents").select("doc_id", "text")
    held_out = F.coalesce(_fold(4) == 2, F.lit(True))
    model = fit_toxicity(docs, _read(spark, folder, "labels").filter(~held_out))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    decoded = decode_ids(encode_texts(_read(spark, folder, "documents")))
    return decoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return rank_documents(_read(spark, folder, "documents"), _read(spark, folder, "benchmark"))


def op13_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    arranged = restore_texts(fill_in_middle(_read(spark, folder, "documents")))
    return arranged.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"),
    )


QUERIES = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_chat_format": op3_chat_format,
    "op4_packing": op4_packing,
    "op5_line_dedup": op5_line_dedup,
    "op5_line_runs": op5_line_runs,
    "op6_language_id": op6_language_id,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_output": op9_token_output,
    "op10_toxicity": op10_toxicity,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_lexical_search": op12_lexical_search,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLES = {
    # every window's first start by text; a later start takes its 20 words
    "op1_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (SELECT doc_id, unnest(range(1, len(w) - 18)) AS p, w FROM d),
        t AS (SELECT doc_id, p, array_to_string(w[p:p + 19], ' ') AS seq FROM s),
        r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY seq ORDER BY doc_id, p) AS k FROM t),
        g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM r WHERE k > 1),
        x AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
        k AS (SELECT x.doc_id, COUNT(g.p) AS n_removed,
                     coalesce(string_agg(CASE WHEN g.p IS NULL THEN word END, ' ' ORDER BY x.p), '') AS kept
              FROM x LEFT JOIN g ON x.doc_id = g.doc_id AND x.p = g.p GROUP BY x.doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN k ON d.doc_id = k.doc_id""",
    # all windows of the documents, of every length an item's windows have
    "op2_decontamination": r"""
        WITH l AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents
                   UNION ALL SELECT 'b', item_id, text FROM benchmark),
        t AS (SELECT kind, id, regexp_extract_all(
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM l),
        b AS (SELECT DISTINCT id AS item_id, size, array_to_string(w[p:p + size - 1], ' ') AS seq
              FROM (SELECT id, w, least(len(w), 13) AS size, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p
                    FROM t WHERE kind = 'b' AND len(w) > 0)),
        n AS (SELECT DISTINCT size FROM b),
        d AS (SELECT id AS doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') AS seq
              FROM (SELECT id, w, size, unnest(range(1, len(w) - size + 2)) AS p FROM t, n WHERE kind = 'd')),
        m AS (SELECT d.doc_id, d.p, d.size, b.item_id FROM d JOIN b ON d.seq = b.seq AND d.size = b.size),
        h AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit
              FROM (SELECT doc_id, unnest(range(p, p + size)) AS p FROM m) GROUP BY doc_id),
        i AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
              FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
        SELECT t.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM t LEFT JOIN h ON h.doc_id = t.id LEFT JOIN i ON i.doc_id = t.id WHERE kind = 'd'""",
    # formatted length: 8 + 8 + 8 characters of marks (end: 7 and a line feed), one
    # more for each control string and each backslash
    "op3_chat_format": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
                   UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
        m AS (SELECT *, role = 'assistant' AS learned,
                     24 + length(role) + length(text)
                     + len(regexp_extract_all(role, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>'))
                     + len(regexp_extract_all(text, '\\|<\||</?s>|\[/?INST\]|<</?SYS>>')) AS chars FROM t)
        SELECT conv_id, COUNT(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(SUM(length(text)) FILTER (learned), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (learned), '')) AS loss_sha256,
               CAST(SUM(chars) AS BIGINT) AS formatted_chars
        FROM m GROUP BY conv_id""",
    # chunks end where h(line) + 31 h(line before) is a multiple of four
    "op5_line_dedup": r"""
        WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, i, lines[i] AS line, CAST('0x' || substr(md5(lines[i]), 1, 7) AS BIGINT) AS h
              FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM d)),
        b AS (SELECT *, CAST((h + 31 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0)) % 4 = 0 AS INTEGER) AS cut FROM l),
        c AS (SELECT *, coalesce(SUM(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM b),
        k AS (SELECT doc_id, part, MIN(i) AS p, COUNT(*) AS n, string_agg(line, chr(10) ORDER BY i) AS chunk FROM c GROUP BY 1, 2),
        r AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, p) AS nth FROM k WHERE n > 1),
        g AS (SELECT doc_id, part FROM r WHERE nth > 1),
        x AS (SELECT c.doc_id, COUNT(*) AS n_lines, COUNT(g.part) AS n_removed,
                     string_agg(CASE WHEN g.part IS NULL THEN line END, chr(10) ORDER BY i) AS kept
              FROM c LEFT JOIN g ON c.doc_id = g.doc_id AND c.part = g.part GROUP BY c.doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN x ON d.doc_id = x.doc_id""",
    # every two adjacent lines' first place; a later place takes both lines
    "op5_line_runs": r"""
        WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
        l AS (SELECT doc_id, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS line FROM d),
        p AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS following FROM l),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY line, following ORDER BY doc_id, i) AS nth
              FROM p WHERE following IS NOT NULL),
        g AS (SELECT DISTINCT doc_id, unnest([i, i + 1]) AS i FROM r WHERE nth > 1),
        x AS (SELECT l.doc_id, COUNT(*) AS n_lines, COUNT(g.i) AS n_removed,
                     string_agg(CASE WHEN g.i IS NULL THEN line END, chr(10) ORDER BY l.i) AS kept
              FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed,
               sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN x ON d.doc_id = x.doc_id""",
    # all pairs that share a shingle, then the links' transitive closure
    "op7_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        s AS (SELECT DISTINCT doc_id, sh FROM (
            SELECT doc_id, array_to_string(w[p:p + 4], ' ') AS sh
            FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0))),
        n AS (SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id),
        i AS (SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS i FROM s a JOIN s b ON a.sh = b.sh
              AND a.doc_id <> b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM i JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
              WHERE 100 * i >= 80 * (a.n + b.n - i)),
        r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.c = l.x)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id
        FROM d LEFT JOIN n ON n.doc_id = d.doc_id
        JOIN (SELECT doc_id, MIN(c) AS c FROM r GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
    "op8_exact_dedup": """
        SELECT doc_id, MAX(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size,
               doc_id = MAX(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    # every document's score for every item, from all its terms
    "op12_lexical_search": r"""
        WITH d AS (SELECT row_number() OVER () AS row_id, doc_id, regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        c AS (SELECT COUNT(*) AS N, CAST(SUM(len(w)) AS BIGINT) AS L FROM d WHERE len(w) > 0),
        m AS (SELECT row_id, doc_id, 100 - 25 + ((25 * len(w) * N) // L) AS m FROM d, c WHERE len(w) > 0),
        t AS (SELECT row_id, term, COUNT(*) AS tf FROM (SELECT row_id, unnest(w) AS term FROM d) GROUP BY row_id, term),
        v AS (SELECT term, CAST(floor(1000 * ln((2 * MAX(N) + 2) / (2 * COUNT(*) + 1))) AS BIGINT) AS weight
              FROM t, c GROUP BY term),
        q AS (SELECT item_id, term, COUNT(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(
                  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY item_id, term),
        s AS (SELECT item_id, doc_id, row_id,
                     CAST(SUM(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
              FROM q JOIN v USING (term) JOIN t USING (term) JOIN m USING (row_id) GROUP BY item_id, doc_id, row_id),
        r AS (SELECT item_id, doc_id, score, CAST(row_number() OVER (
                  PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank FROM s WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20""",
    "op13_fill_in_middle": """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        h AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
                     CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
        c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                               OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
        p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
               sha256(text) AS restored_sha256
        FROM p""",
}
