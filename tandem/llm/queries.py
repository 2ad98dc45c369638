"""The contract queries of the thirteen operators, with DuckDB SQL where SQL can express them.

op1 (a tokenizer), op2 and op4 (trained models) have no SQL; op3 compares bytes of UTF-8 windows, which SQL
is too slow for; op13 needs two tokenizers. The SQL of op11 is exact, and so is the search
on a small table. They are tested against brute force, exact round trips or held-out accuracy in ``tests/llm``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tandem.llm.anisotropic_search import nearest_of_hundredth
from tandem.llm.chat_format import chat_digest, chat_sql, with_probe
from tandem.llm.common import table
from tandem.llm.decontaminate import contamination_digest
from tandem.llm.embedding_dedup import near_vectors
from tandem.llm.language_id import language_digest
from tandem.llm.merkle import manifest_digest
from tandem.llm.minhash_dedup import near_duplicate_digest
from tandem.llm.packing import pack
from tandem.llm.phrase_dedup import phrase_digest
from tandem.llm.suffix_dedup import suffix_digest
from tandem.llm.token_align import alignment_digest
from tandem.llm.toxicity import toxicity_digest
from tandem.llm.url_filter import judge_sql, judge_urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": lambda spark, sf: pack(table(spark, sf, "documents")),
        "op2_language_id": lambda spark, sf: language_digest(table(spark, sf, "documents")),
        "op3_suffix_dedup": lambda spark, sf: suffix_digest(table(spark, sf, "documents"), words=50),
        "op4_toxicity": lambda spark, sf: toxicity_digest(table(spark, sf, "documents"), table(spark, sf, "labels")),
        "op5_decontaminate": lambda spark, sf: contamination_digest(table(spark, sf, "documents"), table(spark, sf, "benchmark")),
        "op6_phrase_dedup": lambda spark, sf: phrase_digest(table(spark, sf, "documents")),
        "op7_chat_format": lambda spark, sf: chat_digest(with_probe(spark, table(spark, sf, "conversations"))),
        "op8_url_filter": lambda spark, sf: judge_urls(table(spark, sf, "pages")),
        "op9_minhash_dedup": lambda spark, sf: near_duplicate_digest(table(spark, sf, "documents")),
        "op10_embedding_dedup": lambda spark, sf: near_vectors(table(spark, sf, "embeddings")),
        "op11_nearest_neighbours": lambda spark, sf: nearest_of_hundredth(table(spark, sf, "embeddings")),
        "op12_merkle_manifest": lambda spark, sf: manifest_digest(table(spark, sf, "documents")),
        "op13_token_alignment": lambda spark, sf: alignment_digest(table(spark, sf, "documents")),
    }


_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bi AS (
  SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, CAST(len(w) - least(13, len(w)) + 2 AS BIGINT))) AS i FROM bw WHERE len(w) > 0
), bwin AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM bi
), sizes AS (
  SELECT DISTINCT n FROM bwin
), di AS (
  SELECT doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS i FROM dw CROSS JOIN sizes WHERE len(w) >= n
), dwin AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS g FROM di
), hits AS (
  SELECT doc_id, i, n, item_id FROM dwin JOIN bwin USING (n, g)
), places AS (
  SELECT DISTINCT doc_id, unnest(range(CAST(i AS BIGINT), CAST(i + n AS BIGINT))) AS p FROM hits
), hit AS (
  SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit ON dw.doc_id = hit.doc_id LEFT JOIN items ON dw.doc_id = items.doc_id"""

OP6 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents
), di AS (
  SELECT doc_id, w, unnest(range(1, CAST(len(w) - 48 AS BIGINT))) AS i FROM d WHERE len(w) >= 50
), win AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 49], ' ')) AS g FROM di
), least_doc AS (
  SELECT g, min(doc_id) AS m FROM win GROUP BY g
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(CAST(i AS BIGINT), CAST(i + 50 AS BIGINT))) AS p FROM win JOIN least_doc USING (g) WHERE m < doc_id
), word AS (
  SELECT doc_id, unnest(w) AS x, unnest(range(1, CAST(len(w) + 1 AS BIGINT))) AS p FROM d WHERE len(w) > 0
), kept AS (
  SELECT word.doc_id, count(*) AS n_kept, string_agg(x, ' ' ORDER BY word.p) AS t
  FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.p = gone.p WHERE gone.p IS NULL GROUP BY word.doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

OP9 = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '{_SPACED}') AS w FROM documents
), di AS (
  SELECT doc_id, w, unnest(range(1, CAST(greatest(len(w) - 3, 1) + 1 AS BIGINT))) AS i FROM d WHERE len(w) > 0
), s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + 3], ' ')) AS g FROM di
), size AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), both_ AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM both_ JOIN size p ON x = p.doc_id JOIN size q ON y = q.doc_id WHERE 100 * k >= 80 * (p.n + q.n - k)
), reach AS (
  SELECT doc_id AS x, doc_id AS r FROM d
  UNION SELECT link.y, reach.r FROM reach JOIN link ON link.x = reach.x
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, d.doc_id = m AS kept
FROM d LEFT JOIN size ON d.doc_id = size.doc_id JOIN (SELECT x, min(r) AS m FROM reach GROUP BY x) c ON d.doc_id = c.x"""

OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
), good AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS x, vec_id AS r FROM embeddings
  UNION SELECT link.y, reach.r FROM reach JOIN link ON link.x = reach.x
)
SELECT e.vec_id, (SELECT count(*) FROM link WHERE link.x = e.vec_id) AS n_links, m AS component_id, e.vec_id = m AS kept
FROM embeddings e JOIN (SELECT x, min(r) AS m FROM reach GROUP BY x) c ON e.vec_id = c.x"""

OP11 = """
WITH v AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), good AS (
  SELECT * FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), pair AS (
  SELECT q.vec_id AS query_id, q.e AS own, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
  FROM good q JOIN good c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score, vec_id) AS rank FROM pair) WHERE rank <= 10"""

#: CRC-32 of the decimal doc_id, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda crc, c: list_reduce(list_concat([xor(crc, c)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)"
_ITEM = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')".format
_HEAD = " || ".join(map(_ITEM, ("doc_id", "source", "lang", "n_chars")))

OP12 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, sha256({_HEAD} || {_ITEM("text")}) AS leaf, sha256({_HEAD} || coalesce(CASE WHEN {_CRC} % 2 = 0 THEN {_ITEM("replace(text, chr(10), '')")} END, {_ITEM("text")})) AS seen FROM documents
), placed AS (
  SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d
), node AS (
  SELECT tree, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY tree) AS n FROM placed
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 2) // 3) FROM node WHERE n > 1 GROUP BY tree, level, pos // 3
), subroot AS (
  SELECT tree, digest FROM node WHERE n = 1
), uppers AS (
  SELECT 0 AS level, tree AS pos, digest, count(*) OVER () AS n FROM subroot
  UNION ALL
  SELECT level + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 2) // 3) FROM uppers WHERE n > 1 GROUP BY level, pos // 3
), root AS (
  SELECT digest FROM uppers WHERE n = 1
), high AS (
  SELECT tree, max(level) AS top FROM node GROUP BY tree
), every AS (
  SELECT tree, level, pos, digest FROM node WHERE n > 1
  UNION ALL
  SELECT NULL, level, pos, digest FROM uppers WHERE n > 1
), side AS (
  SELECT a.tree, a.level, a.pos, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l, coalesce(string_agg(b.digest, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
  FROM every a JOIN every b ON a.tree IS NOT DISTINCT FROM b.tree AND a.level = b.level AND a.pos // 3 = b.pos // 3 GROUP BY ALL
), walk AS (
  SELECT doc_id, leaf, seen, placed.tree AS own, placed.pos AS place, 0 AS step, seen AS digest, '' AS proof, top, (SELECT max(level) FROM uppers) AS summit FROM placed JOIN high USING (tree)
  UNION ALL
  SELECT doc_id, leaf, seen, own, place, step + 1, sha256(l || walk.digest || r), proof || l || r, top, summit
  FROM walk JOIN side ON side.tree IS NOT DISTINCT FROM (CASE WHEN step < top THEN own END)
    AND side.level = CASE WHEN step < top THEN step ELSE step - top END
    AND side.pos = CAST(CASE WHEN step < top THEN place // CAST(pow(3, step) AS BIGINT) ELSE own // CAST(pow(3, step - top) AS BIGINT) END AS BIGINT)
)
SELECT doc_id, leaf, subroot.digest AS subroot, root.digest AS root, sha256(proof) AS proof_sha256, walk.digest AS folded_root, walk.digest = root.digest AS verified
FROM walk JOIN subroot ON subroot.tree = own CROSS JOIN root WHERE step = top + summit"""



def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": OP5, "op6_phrase_dedup": OP6, "op7_chat_format": chat_sql(), "op8_url_filter": judge_sql(), "op9_minhash_dedup": OP9, "op10_embedding_dedup": OP10, "op11_nearest_neighbours": OP11, "op12_merkle_manifest": OP12}
