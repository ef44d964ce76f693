"""The registered queries: each applies one operator to its whole table; digests are taken from what it returns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, language, linededup, minhash, mixing, neighbours, pii, quality, sharding, simhash, tensorbands, vectorcodes
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources by the weights 5, 2, 1 takes of each document."""
    docs = table(spark, sf_dir, "documents")
    mix = mixing.Mix(docs)
    found = mix.dealt(docs)
    return found.select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__size") * F.col("__copies")).alias("taken"),
        F.col("__shards").alias("shards"),
        F.col("__slots").alias("slots"),
    )


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all texts, against those of their edited texts and of the next documents."""
    found = minhash.against_edits(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def op3_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards along the Hilbert curve, by equal row counts."""
    placed = sharding.hilbert_shards(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "curve",
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that several documents hold go, but for the first document's."""
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text: counts and digest of the patterns' spans, and all spans."""
    found = pii.detect(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2(F.encode("base", "UTF-8"), 256)).drop("base")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest other vectors of every vector whose id is divisible by 50."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every whole text; documents of one remainder of seven are held out."""
    remainder = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 7
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return language.score(docs.withColumn("held", F.coalesce(remainder == 2, F.lit(False))), "held")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded with the word tokenizer."""
    encoded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return encoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components that links of up to 3 bits make."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, reach=3)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both views' and the combined quality score of every document, and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.classify(docs, table(spark, sf_dir, "labels")).select(
        "doc_id",
        F.col("__text_score").alias("text_score"),
        F.col("__metadata_score").alias("metadata_score"),
        F.col("__quality").alias("quality_score"),
        (F.col("__quality") >= quality.THRESHOLD).alias("kept"),
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired rows of every damaged conversation."""
    rows = table(spark, sf_dir, "conversations")
    return conversations.repair(conversations.damaged(rows), rows)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors by 16 codebooks of 64 entries, with their errors and the digest of the codebooks."""
    found = vectorcodes.Compressor(table(spark, sf_dir, "embeddings"))
    return found.encoded().select(
        "vec_id",
        F.lower(F.hex("codes")).alias("code"),
        "error",
        "label_error",
        F.lit(found.digest()).alias("codebooks_sha256"),
    )


def op13_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles are alike by 0.8 or more."""
    return tensorbands.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_mixing": op1_mixing,
    "op2_minhash": op2_minhash,
    "op3_hilbert": op3_hilbert,
    "op4_line_dedup": op4_line_dedup,
    "op5_pii": op5_pii,
    "op6_neighbours": op6_neighbours,
    "op7_language": op7_language,
    "op8_bpe": op8_bpe,
    "op9_simhash": op9_simhash,
    "op10_quality": op10_quality,
    "op11_repair": op11_repair,
    "op12_vector_codes": op12_vector_codes,
    "op13_tensored_minhash": op13_tensored_minhash,
}


def _nearest_entries(step: int) -> str:
    return f"""
    , nearest{step} AS (
        SELECT vec_id, label, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d, any_value(v) AS v FROM (
            SELECT p.vec_id, p.label, p.part, p.v, e.entry,
                   list_sum(list_transform(list_zip(p.v, e.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) AS d
            FROM pieces p JOIN entries{step} e USING (part))
        GROUP BY vec_id, label, part)"""


def _moved_entries(step: int) -> str:
    return f"""
    , means{step} AS (
        SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY position) AS v FROM (
            SELECT part, entry, position, sum(x)::BIGINT AS s, count(*)::BIGINT AS n FROM (
                SELECT part, entry, unnest(v) AS x, generate_subscripts(v, 1) AS position FROM nearest{step})
            GROUP BY part, entry, position)
        GROUP BY part, entry)
    , entries{step + 1} AS (
        SELECT part, entry, coalesce(m.v, e.v) AS v FROM entries{step} e LEFT JOIN means{step} m USING (part, entry))"""


_VECTOR_CODES = (
    """
    WITH kept AS (
        SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
        FROM embeddings WHERE embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    pieces AS (
        SELECT vec_id, label, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] AS v
        FROM kept, (SELECT unnest(range(16)) AS part)),
    seeds AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM kept QUALIFY entry < 64),
    entries0 AS (SELECT part, entry, v FROM pieces JOIN seeds USING (vec_id))"""
    + _nearest_entries(0) + _moved_entries(0) + _nearest_entries(1) + _moved_entries(1) + _nearest_entries(2)
    + """
    , codes AS (
        SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code,
               CAST(sum(d) AS BIGINT) AS error
        FROM nearest2 GROUP BY vec_id),
    digest AS (
        SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM entries2)
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM codes, digest"""
)

# A state of the grammar holds cost, audit and lines of the best repair of all later rows.
_CONVERSATION_REPAIR = """
    WITH RECURSIVE crc AS (
        SELECT list(list_reduce([n] || [0, 0, 0, 0, 0, 0, 0, 0],
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS tab
        FROM (SELECT unnest(range(256))::BIGINT AS n)),
    named AS (
        SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role,
               coalesce(text, ' ') AS text,
               coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
        FROM conversations),
    kinds AS (
        SELECT * EXCLUDE (name), xor(list_reduce(
                   [4294967295::BIGINT] || list_transform(string_split(name, ''), lambda x: CAST(ord(x) AS BIGINT)),
                   lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind
        FROM named, crc),
    damaged AS (
        SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
               unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
        FROM kinds WHERE kind <> 0),
    placed AS (
        SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text, copy) AS i,
               regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z', 1) AS tail
        FROM damaged),
    faults AS (
        SELECT *, CASE WHEN tail = '' THEN 'blank'
                       WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                       WHEN tail NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
               lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) || left(role, 1) AS pair
        FROM placed),
    counted AS (
        SELECT c, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n,
               count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
               count(*) FILTER (fault = 'truncated') AS truncated,
               count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
        FROM faults GROUP BY c),
    best AS (
        SELECT c, n + 1 AS i, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS f0,
               {'cost': 10::BIGINT, 'audit': 'II', 'lines': ['user:', 'assistant:']} AS f1,
               {'cost': 5::BIGINT, 'audit': 'I', 'lines': ['assistant:']} AS f2,
               {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS f3
        FROM counted
        UNION ALL
        SELECT c, i, least(b0, {'cost': g2.cost + 5, 'audit': 'I' || g2.audit, 'lines': ['user:'] || g2.lines}),
               least(b1, {'cost': g2.cost + 5, 'audit': 'I' || g2.audit, 'lines': ['user:'] || g2.lines}), g2, g3
        FROM (
            SELECT c, i, b0, b1,
                   least(b2, {'cost': b3.cost + 5, 'audit': 'I' || b3.audit, 'lines': ['assistant:'] || b3.lines}) AS g2,
                   least(b3, {'cost': b2.cost + 5, 'audit': 'I' || b2.audit, 'lines': ['user:'] || b2.lines}) AS g3
            FROM (
                SELECT r.c, r.i,
                       least({'cost': f0.cost + 2, 'audit': 'D' || f0.audit, 'lines': f0.lines},
                             CASE WHEN stays AND x = 's' THEN {'cost': f1.cost + more, 'audit': 'K' || f1.audit, 'lines': [line] || f1.lines}
                                  WHEN stays AND x = 'u' THEN {'cost': f2.cost + more, 'audit': 'K' || f2.audit, 'lines': [line] || f2.lines} END,
                             CASE WHEN stays THEN {'cost': f2.cost + more + 1, 'audit': 'R' || f2.audit, 'lines': ['user:' || text] || f2.lines} END) AS b0,
                       least({'cost': f1.cost + 2, 'audit': 'D' || f1.audit, 'lines': f1.lines},
                             CASE WHEN stays AND x = 'u' THEN {'cost': f2.cost + more, 'audit': 'K' || f2.audit, 'lines': [line] || f2.lines} END,
                             CASE WHEN stays THEN {'cost': f2.cost + more + 1, 'audit': 'R' || f2.audit, 'lines': ['user:' || text] || f2.lines} END) AS b1,
                       least({'cost': f2.cost + 2, 'audit': 'D' || f2.audit, 'lines': f2.lines},
                             CASE WHEN stays AND x = 'a' THEN {'cost': f3.cost + more, 'audit': 'K' || f3.audit, 'lines': [line] || f3.lines} END,
                             CASE WHEN stays THEN {'cost': f3.cost + more + 1, 'audit': 'R' || f3.audit, 'lines': ['assistant:' || text] || f3.lines} END) AS b2,
                       least({'cost': f3.cost + 2, 'audit': 'D' || f3.audit, 'lines': f3.lines},
                             CASE WHEN stays AND x = 'u' THEN {'cost': f2.cost + more, 'audit': 'K' || f2.audit, 'lines': [line] || f2.lines} END,
                             CASE WHEN stays THEN {'cost': f2.cost + more + 1, 'audit': 'R' || f2.audit, 'lines': ['user:' || text] || f2.lines} END) AS b3
                FROM best JOIN (
                    SELECT c, i, text, role || ':' || text AS line, left(role, 1) AS x,
                           coalesce(fault NOT IN ('blank', 'duplicate'), true) AS stays,
                           CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM faults
                ) r ON r.c = best.c AND r.i = best.i - 1)))
    SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(f0.cost, 0) AS cost,
           coalesce(f0.audit, '') AS audit, sha256(coalesce(array_to_string(f0.lines, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT c, conv_id FROM named) LEFT JOIN counted USING (c)
    LEFT JOIN (SELECT c, f0 FROM best WHERE i = 1) USING (c)"""

_ALIKE_SETS = """
    WITH RECURSIVE words AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
               'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
        FROM documents),
    shingles AS (
        SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
        FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM words WHERE len(w) > 0)),
    sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
    common AS (
        SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
        FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
    links AS (
        SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
        WHERE 100 * common >= 80 * (x.n + y.n - common)),
    ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reached AS (
        SELECT doc_id AS a, doc_id AS b FROM documents
        UNION SELECT reached.a, ways.b FROM reached JOIN ways ON reached.b = ways.a),
    components AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
    FROM documents d LEFT JOIN sizes USING (doc_id) JOIN components USING (doc_id)"""

SQL: dict[str, str] = {
    "op11_repair": _CONVERSATION_REPAIR,
    "op13_tensored_minhash": _ALIKE_SETS,
    "op12_vector_codes": _VECTOR_CODES,
    "op4_line_dedup": """
        WITH lines AS (
            SELECT doc_id, n, line, translate(
                trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n
                  FROM documents)),
        repeated AS (
            SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10
            GROUP BY key HAVING count(DISTINCT doc_id) >= 2)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (owner <> doc_id) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (owner IS NULL OR owner = doc_id), ''))
                   AS kept_sha256
        FROM lines LEFT JOIN repeated USING (key) GROUP BY doc_id""",
    "op6_neighbours": """
        WITH vectors AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        ranked AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score,
                   CAST(row_number() OVER (PARTITION BY q.vec_id
                       ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank
            FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
}
