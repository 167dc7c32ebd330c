"""Registered queries of the text operators and their DuckDB SQL.

Each query applies its operator with production parameters to its whole
table.  Where SQL cannot express an operator, or only far too slowly on whole
tables, there is no SQL; ``tests/llm`` holds the query against a brute-force
version instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_format
from .common import read_table
from .decontaminate import decontaminate
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .lexical_search import ranked_search
from .license_scan import license_scan
from .line_dedup import line_dedup
from .packing import pack
from .passages import shared_passages
from .quality import quality_classifier
from .spelling import spelling_groups
from .suffix_dedup import substring_dedup
from .toxicity import toxicity
from .warc import derive, responses


def op1_quality_classifier(spark, sf_dir):
    return quality_classifier(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op2_line_dedup(spark, sf_dir):
    return line_dedup(read_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark, sf_dir):
    """The substring dedup, and as a column of its own what is shorter than its
    400 bytes: passages of over 50 words that other documents hold too."""
    docs = read_table(spark, sf_dir, "documents")
    return (substring_dedup(docs).drop("spans").join(shared_passages(docs), "doc_id", "left")
            .withColumn("n_passage_anchors", F.coalesce("n_passage_anchors", F.lit(0).cast("long"))))


def op4_exact_dedup(spark, sf_dir):
    return exact_dedup(read_table(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return pack(read_table(spark, sf_dir, "documents"))


def op6_jaccard_join(spark, sf_dir):
    return jaccard_components(read_table(spark, sf_dir, "documents"), k=4, percent=85)


def op7_decontamination(spark, sf_dir):
    return decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_warc_derivatives(spark, sf_dir):
    return derive(responses(read_table(spark, sf_dir, "pages")), key="page_id")


def op9_license_scan(spark, sf_dir):
    return license_scan(read_table(spark, sf_dir, "documents"))[0]


def op10_chat_format(spark, sf_dir):
    """All conversations, and conversation -7, whose texts hold control
    strings, as a log of deltas, edits and regenerations."""
    probe = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)],
                                  "conv_id long, turn long, role string, text string")
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    log = chat_format.streamed_log(rows)
    return chat_format.read_back(chat_format.render(chat_format.reconstruct(log)))


def op11_spelling_variants(spark, sf_dir):
    return spelling_groups(read_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark, sf_dir):
    return ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_toxicity(spark, sf_dir):
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_line_dedup, op3_suffix_dedup, op4_exact_dedup, op5_packing, op6_jaccard_join,
    op7_decontamination, op8_warc_derivatives, op9_license_scan, op10_chat_format,
    op11_spelling_variants, op12_ranked_search, op13_toxicity)}

_SPACES = r"'[\x20\x09-\x0D]+'"
_STRIPS = r"'^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$'"
_TERM = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
_UPPER, _LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"



def _escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in chat_format.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


_MARKS = len(chat_format.TURN) + len(chat_format.TEXT) + len(chat_format.END)

ORACLE_SQL = {
    "op2_line_dedup": f"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i,
                         unnest(string_split(text, chr(10))) AS line FROM docs),
        keyed AS (SELECT doc_id, i, line,
                         translate(regexp_replace(line, {_STRIPS}, '', 'g'), {_UPPER}, {_LOWER}) AS k FROM lines),
        lost AS (SELECT k, max(doc_id) AS keep_doc FROM keyed WHERE length(k) >= 40
                 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
        marked AS (SELECT doc_id, i, line, coalesce(doc_id <> keep_doc, false) AS dropped
                   FROM keyed LEFT JOIN lost USING (k))
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT dropped), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {_SPACES}, ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op7_decontamination": f"""
        WITH texts AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL
                       UNION ALL SELECT 'i', item_id, text FROM benchmark WHERE item_id IS NOT NULL),
        w AS (SELECT kind, id, list_filter(string_split_regex(translate(coalesce(text, ''), {_UPPER}, {_LOWER}), {_SPACES}),
                                           lambda x: x <> '') AS w FROM texts),
        items AS (SELECT id AS item_id, least(len(w), 5) AS k, w FROM w WHERE kind = 'i' AND len(w) > 0),
        item_grams AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
                       FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM items)),
        sizes AS (SELECT item_id, k, count(*) AS n_item FROM item_grams GROUP BY item_id, k),
        doc_grams AS (SELECT DISTINCT id AS doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
                      FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS p
                            FROM w, (SELECT DISTINCT k FROM items) WHERE kind = 'd'))
        SELECT doc_id, item_id, n_item AS item_shingles, count(*) AS shared, count(*) / n_item AS containment
        FROM doc_grams JOIN item_grams USING (k, s) JOIN sizes USING (item_id, k)
        GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 80""",
    "op10_chat_format": f"""
        WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                      UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'),
                                       (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(length({_escaped('role')}) + length({_escaped('text')}) + {_MARKS})::BIGINT AS formatted_chars
        FROM rows GROUP BY conv_id""",
    "op11_spelling_variants": f"""
        WITH RECURSIVE crc AS (
            SELECT list_transform(range(256), lambda b: list_reduce(range(8),
                       lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
        found AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS raw FROM documents),
        runs AS (SELECT translate(raw, {_UPPER}, {_LOWER}) AS w, coalesce(doc_id::VARCHAR, '') || ':' || w AS key, count(*) AS n
                 FROM found GROUP BY doc_id, w),
        bytes AS (SELECT w, n, hex(encode(key)) AS x FROM runs),
        hashed AS (SELECT w, n, xor(list_reduce(range(length(x) // 2), lambda c, i: xor(c >> 8, t[
                       (xor(c, ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) & 255) + 1]), 4294967295), 4294967295) AS h
                   FROM bytes, crc),
        made AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n
                 FROM hashed),
        words AS (SELECT word, sum(n)::BIGINT AS n FROM made WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
        cuts AS (SELECT word, n, p, left(word, p - 1) || substr(word, p + 1) AS rest
                 FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
        near AS (SELECT DISTINCT a.word, b.word AS other, b.n AS m FROM cuts a JOIN cuts b USING (p, rest) WHERE a.word <> b.word
                 UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
                 UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
        best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
        forms AS (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN best.m >= 5 * words.n THEN
                      (SELECT min(other) FROM near WHERE near.word = words.word AND near.m = best.m) END AS form,
                  CASE WHEN best.m >= 5 * words.n THEN best.m END AS form_n FROM words LEFT JOIN best USING (word)),
        steps AS (SELECT word, word AS here FROM forms UNION ALL
                  SELECT steps.word, forms.form FROM steps JOIN forms ON steps.here = forms.word WHERE forms.form IS NOT NULL),
        ends AS (SELECT steps.word, here AS root FROM steps JOIN forms ON here = forms.word WHERE forms.form IS NULL)
        SELECT word, n, n_near, form, form_n, root FROM forms JOIN ends USING (word)""",
    "op12_ranked_search": f"""
        WITH w AS (SELECT doc_id, row_number() OVER () AS d, unnest(regexp_extract_all(text, {_TERM})) AS raw FROM documents),
        tf AS (SELECT d, any_value(doc_id) AS doc_id, translate(raw, {_UPPER}, {_LOWER}) AS term, count(*) AS tf
               FROM w GROUP BY d, term),
        n AS (SELECT d, sum(tf)::BIGINT AS n FROM tf GROUP BY d),
        total AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS l FROM n),
        weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w
                   FROM tf, total GROUP BY term, n_docs),
        m AS (SELECT d, 100 - 25 + (25 * n * n_docs) // l AS m FROM n, total),
        raw_items AS (SELECT item_id, row_number() OVER () AS i, unnest(regexp_extract_all(text, {_TERM})) AS raw FROM benchmark),
        items AS (SELECT i, any_value(item_id) AS item_id, translate(raw, {_UPPER}, {_LOWER}) AS term, count(*) AS c
                  FROM raw_items GROUP BY i, term),
        scored AS (SELECT i, any_value(item_id) AS item_id, any_value(doc_id) AS doc_id,
                          sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
                   FROM items JOIN tf USING (term) JOIN weight USING (term) JOIN m USING (d) GROUP BY i, d),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id) AS rank
                   FROM scored WHERE score > 0 AND doc_id IS NOT NULL)
        SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 20""",
}
