"""The queries of the operators for training data, with their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidepanel.llm import quality
from tidepanel.llm.exact_dedup import mark_copies
from tidepanel.llm.fill_middle import fill_digests
from tidepanel.llm.fingerprints import fingerprint_edits
from tidepanel.llm.ngram_join import near_copies
from tidepanel.llm.personal_data import find_personal_data, span_digests
from tidepanel.llm.piece_bpe import encode_digests
from tidepanel.llm.source_mix import mix
from tidepanel.llm.substring_dedup import remove_repeats
from tidepanel.llm.tables import documents, table
from tidepanel.llm.token_files import read_ids, write_ids
from tidepanel.llm.token_transducer import count_tokens
from tidepanel.llm.turn_repair import damaged, repair
from tidepanel.llm.url_filter import judge

END_ID = 1


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return read_ids(write_ids(documents(spark, sf_dir), path, END_ID))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(documents(spark, sf_dir)).drop("root", "th")


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digests(find_personal_data(documents(spark, sf_dir)))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_copies(documents(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("removed")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.score_documents(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(documents(spark, sf_dir))


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_digests(documents(spark, sf_dir)).drop("segments")


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_source_mix": op2_source_mix,
    "op3_token_files": op3_token_files,
    "op4_ngram_join": op4_ngram_join,
    "op5_piece_bpe": op5_piece_bpe,
    "op6_personal_data": op6_personal_data,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality": op9_quality,
    "op10_fingerprints": op10_fingerprints,
    "op11_fill_middle": op11_fill_middle,
    "op12_turn_repair": op12_turn_repair,
    "op13_url_filter": op13_url_filter,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _draw(k: int) -> str:
    start = 8 * k - 7
    return f"('0x' || substr(sha256('1:' || coalesce(doc_id::VARCHAR, '')), {start}, 8))::BIGINT"


def _least(*ways: str) -> str:
    """The cheapest of (cost, audit) structs, of equal ones the one with the least audit."""
    return f"list_min([{', '.join(ways)}])"


def _way(before: str, cost: str, letter: str, only_if: str = "true") -> str:
    far = "{'c': 1000000000::BIGINT, 'a': ''}"
    return f"CASE WHEN {only_if} THEN {{'c': {before}.c + {cost}, 'a': {before}.a || '{letter}'}} ELSE {far} END"


_WORDS = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"

ORACLES = {
    "op4_ngram_join": f"""
        WITH RECURSIVE d AS MATERIALIZED (
            SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents
        ),
        s AS MATERIALIZED (
            SELECT DISTINCT doc_id, array_to_string(words[i : i + 4], ' ') AS s
            FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM d WHERE len(words) > 0)
        ),
        n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        l AS MATERIALIZED (
            SELECT p.x, p.y FROM (
                SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common
                FROM s a JOIN s b ON a.s = b.s AND a.doc_id != b.doc_id GROUP BY ALL
            ) p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y
            WHERE 100 * common >= 75 * (nx.n + ny.n - common)
        ),
        r AS (
            SELECT doc_id AS x, doc_id AS y FROM d
            UNION
            SELECT r.x, l.y FROM r JOIN l ON l.x = r.y
        )
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id
        FROM d LEFT JOIN n USING (doc_id)
        JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)
    """,
    "op8_substring_dedup": f"""
        WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS words FROM documents),
        p AS (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS pos FROM d),
        w AS MATERIALIZED (SELECT doc_id, pos, array_to_string(words[pos : pos + 12], ' ') AS w FROM p),
        f AS (SELECT w, min(doc_id) AS least FROM w GROUP BY w),
        gone AS (
            SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS place
            FROM w JOIN f USING (w) WHERE doc_id > least
        ),
        g AS (SELECT doc_id, list(place) AS gone FROM gone GROUP BY doc_id)
        SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
            sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN words ELSE
                list_filter(words, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
        FROM d LEFT JOIN g USING (doc_id)
    """,
    "op7_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN g USING (norm)
    """,
    "op11_fill_middle": f"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n,
                {_draw(1)} AS h1, {_draw(2)} AS h2, {_draw(3)} AS h3, {_draw(4)} AS h4
            FROM documents
        ),
        c AS (
            SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90
                THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM d
        ),
        o AS (
            SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM c
        )
        SELECT doc_id, n, form,
            CASE WHEN form != 'plain' THEN a END AS prefix_chars, CASE WHEN form != 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(CASE form WHEN 'plain' THEN t ELSE p || m || s END) AS restored_sha256
        FROM o
    """,
    "op12_turn_repair": f"""
        WITH RECURSIVE bits AS (
            SELECT i, 0 AS k, i::BIGINT AS v FROM range(256) r(i)
            UNION ALL
            SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END FROM bits WHERE k < 8
        ),
        crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
        c AS (
            SELECT *, xor(list_reduce(list_transform(string_split(
                    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT),
                    lambda v, x: xor(v // 256, t[xor(v % 256, x) + 1]), 4294967295::BIGINT), 4294967295) % 20 AS kind
            FROM conversations, crc
        ),
        r AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE coalesce(role, ' ') END AS role,
                CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN translate(coalesce(text, ' '), '.!?', '')
                ELSE coalesce(text, ' ') END AS text,
                unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END))
            FROM c WHERE kind != 0
        ),
        o AS (
            SELECT coalesce(conv_id::VARCHAR, '') AS conv, turn, role, text, rtrim(text, {_SPACES}) AS seen, row_number() OVER (
                PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role)::VARCHAR || ':' || role || text)) AS pos
            FROM r
        ),
        f AS MATERIALIZED (
            SELECT conv, pos, turn, role, text, substr(role, 1, 1) AS i,
                CASE WHEN seen = '' THEN 'blank' WHEN pos > min(pos) OVER (PARTITION BY conv, role, text) THEN 'duplicate'
                WHEN right(seen, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY pos) || substr(role, 1, 1) AS pair
            FROM o
        ),
        w AS (
            SELECT conv, 0::BIGINT AS pos, {{'c': 0::BIGINT, 'a': ''}} AS w0, {{'c': 1000000000::BIGINT, 'a': ''}} AS ws,
                {{'c': 3::BIGINT, 'a': 'I'}} AS wu, {{'c': 6::BIGINT, 'a': 'II'}} AS wa
            FROM (SELECT DISTINCT conv FROM f)
            UNION ALL
            SELECT conv, pos, w0, ws, u, {_least("a", _way("u", "3", "I"))}
            FROM (
                SELECT conv, pos, w0, ws, a, {_least("u", _way("w0", "3", "I"), _way("ws", "3", "I"), _way("a", "3", "I"))} AS u
                FROM (
                    SELECT f.conv, f.pos, {_way("w0", "4", "D")} AS w0,
                        {_least(_way("ws", "4", "D"), _way("w0", "e", "K", "ok AND i = 's'"))} AS ws,
                        {_least(_way("wu", "4", "D"), *[_way(w, "e", "K", "ok AND i = 'u'") for w in ("w0", "ws", "wa")],
                                *[_way(w, "e + 3", "R", "ok") for w in ("w0", "ws", "wa")])} AS u,
                        {_least(_way("wa", "4", "D"), _way("wu", "e", "K", "ok AND i = 'a'"), _way("wu", "e + 3", "R", "ok"))} AS a
                    FROM w JOIN (
                        SELECT *, fault NOT IN ('blank', 'duplicate') AS ok, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS e FROM f
                    ) f ON f.conv = w.conv AND f.pos = w.pos + 1
                )
            )
        ),
        best AS (
            SELECT conv, {_least("w0", "wa")} AS b
            FROM w JOIN (SELECT conv, max(pos) AS pos FROM f GROUP BY conv) USING (conv, pos)
        ),
        letters AS (
            SELECT conv, k, substr(b.a, k, 1) AS e FROM (SELECT conv, b, unnest(range(1, length(b.a) + 1)) AS k FROM best)
        ),
        walk AS (
            SELECT *, count(*) FILTER (e != 'I') OVER up AS pos, count(*) FILTER (e != 'D') OVER up AS place
            FROM letters WINDOW up AS (PARTITION BY conv ORDER BY k)
        ),
        turns AS (
            SELECT walk.conv, place, e, text, role, first(e = 'K' AND i = 's') OVER (PARTITION BY walk.conv ORDER BY place) AS led
            FROM walk LEFT JOIN f ON e != 'I' AND f.conv = walk.conv AND f.pos = walk.pos
            WHERE e != 'D'
        ),
        text AS (
            SELECT conv, string_agg(CASE WHEN e = 'K' THEN role WHEN (place + CASE WHEN led THEN 1 ELSE 0 END) % 2 = 1
                THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS t
            FROM turns GROUP BY conv
        ),
        counts AS (
            SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                count(*) FILTER (fault = 'truncated') AS truncated,
                count(*) FILTER (pos > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
            FROM f GROUP BY conv
        )
        SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
            coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0)::BIGINT AS cost,
            coalesce(b.a, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a
        LEFT JOIN counts ON counts.conv = coalesce(a.conv_id::VARCHAR, '')
        LEFT JOIN best ON best.conv = coalesce(a.conv_id::VARCHAR, '')
        LEFT JOIN text ON text.conv = coalesce(a.conv_id::VARCHAR, '')
    """,
}
