"""The registered queries of the corpus operators and, where SQL can say the same, their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from folio.llm import bpe, chat, decon, exact, fingerprint, near, pack, phrases, pii, quality, substring, vectors, warc
from folio.llm.common import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.digest(chat.format_turns(chat.from_rows(turns)))


def chat_mixed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as JSON records of all record layouts, by conv_id, are read by their fingerprints and formatted."""
    turns = chat.from_rows(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")).where("conv_id is not null")
    records = turns.select("conv_id", chat.as_record(F.col("turns"), F.pmod("conv_id", F.lit(len(chat.RECORD_LAYOUTS)))).alias("record"))
    read = chat.from_records(records)
    digest = chat.digest(chat.format_turns(read))
    return read.select("conv_id", "layout").join(digest, "conv_id").select("conv_id", "layout", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(table(spark, sf_dir, "documents"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.personal_data(table(spark, sf_dir, "documents")))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.without_repeats(table(spark, sf_dir, "documents")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("payload")


def op8_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack.pack(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decon.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.vector_codes(table(spark, sf_dir, "embeddings")).drop("label")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


def _vector_sql(rounds: int = vectors.ROUNDS) -> str:
    """Codebooks by rounds of joins: x has a row for each component, c one for each entry's."""
    steps = [
        "kept AS (SELECT vec_id, label, embedding AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0)",
        "x AS MATERIALIZED (SELECT vec_id, (i - 1) // (len(e) // 4) AS part, (i - 1) % (len(e) // 4) AS pos, floor(1024 * e[i]::DOUBLE)::BIGINT AS v FROM (SELECT vec_id, e, unnest(generate_series(1, len(e))) AS i FROM kept))",
        "ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256))",
        "c0 AS MATERIALIZED (SELECT part, entry, pos, v FROM x JOIN ids USING (vec_id))",
    ]
    for k in range(rounds + 1):
        distance = f"SELECT vec_id, x.part, entry, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS d FROM x JOIN c{k} c ON c.part = x.part AND c.pos = x.pos GROUP BY ALL"
        steps.append(f"a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, d * 256 + entry) AS entry, min(d) AS d FROM ({distance}) GROUP BY vec_id, part)")
        mean = f"SELECT x.part, entry, pos, floor(sum(x.v)::DOUBLE / count(*))::BIGINT AS v FROM x JOIN a{k} a ON a.vec_id = x.vec_id AND a.part = x.part GROUP BY x.part, entry, pos"
        steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, c.pos, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN ({mean}) m ON m.part = c.part AND m.entry = c.entry AND m.pos = c.pos)")
    steps.append(f"found AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY vec_id)")
    books = f"(SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY part, entry, pos)) FROM c{rounds})"
    return f"""
        WITH {", ".join(steps[:-2] + steps[-1:])}
        SELECT f.vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, {books} AS codebooks_sha256
        FROM found f JOIN kept USING (vec_id)"""


QUERIES = {f.__name__: f for f in (op1_quality, op2_chat_format, chat_mixed_layouts, op3_exact_dedup, op4_minhash_near_dedup, op5_personal_data, op6_substring_dedup, op7_warc, op8_curve_packing, op9_decontamination, op10_token_counts, op11_vector_codes, op12_collocations, op13_fingerprints)}

SQL = {
    "op11_vector_codes": _vector_sql(),
    "op12_collocations": r"""
        WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
        p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
        w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
        g AS (SELECT lang, k, unnest(list_transform(generate_series(1, len(ws) - k + 1), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k),
        f AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
        n AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
        c AS MATERIALIZED (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND a >= 30),
        cut AS (SELECT c.*, unnest(generate_series(1, k - 1)) AS place FROM c),
        s AS (SELECT c.lang, c.k, c.phrase, c.a, place, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a + r.a))::BIGINT AS score FROM cut c
              JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:place], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[place + 1:], ' ')),
        low AS (SELECT lang, k, phrase, a, min_by(struct_pack(l := l, r := r, score := score), score * 8 + place) AS x FROM s GROUP BY ALL),
        part AS (SELECT lang, k, a, ws, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k > 2),
        held AS (SELECT lang, phrase, max(a) AS longer FROM (SELECT lang, a, unnest(list_transform(generate_series(1, k - m + 1), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS phrase FROM part) GROUP BY ALL),
        kept AS (SELECT low.lang, low.phrase, a, x.l AS l, x.r AS r, x.score AS score, row_number() OVER (PARTITION BY low.lang ORDER BY x.score DESC, a DESC, low.phrase) AS rank
                 FROM low LEFT JOIN held h ON h.lang = low.lang AND h.phrase = low.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
        SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) WHERE rank <= 2000""",
    "op2_chat_format": r"""
        WITH t AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        e AS (SELECT *, length(replace(replace(text, '\', '\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\'), '<|', '<\|'), chr(10), '\n')) + 24 AS chars FROM t)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               sum(chars)::BIGINT AS formatted_chars
        FROM e GROUP BY conv_id""",
    "chat_mixed_layouts": r"""
        WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k, coalesce(role, '') AS role, coalesce(text, '') AS text,
                          ['messages', 'dialogue', 'instruction', 'instruction_input', 'prompt', 'response', 'question', 'system_prompt'][conv_id % 8 + 1] AS layout
                   FROM conversations WHERE conv_id IS NOT NULL),
        c AS (SELECT conv_id, layout, coalesce(min_by(text, k) FILTER (role = 'user'), '') AS u, coalesce(min_by(text, k) FILTER (role = 'assistant'), '') AS a,
                     coalesce(min_by(text, k) FILTER (role = 'system'), '') AS s, string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS every,
                     count(*) AS n, coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '') AS learned FROM t GROUP BY ALL),
        x AS (SELECT conv_id, layout, layout IN ('messages', 'dialogue') AS listed, n, every, learned, u, a, s FROM c),
        y AS (SELECT conv_id, layout, CASE WHEN listed THEN n WHEN layout = 'system_prompt' THEN 3 ELSE 2 END AS n_turns,
                     CASE WHEN listed THEN every ELSE CASE WHEN layout = 'system_prompt' THEN 'system' || chr(10) || s || chr(10) ELSE '' END || 'user' || chr(10) || u
                       || CASE WHEN layout = 'instruction_input' AND s <> '' THEN chr(10) || s ELSE '' END || chr(10) || 'assistant' || chr(10) || a || chr(10) END AS body,
                     CASE WHEN listed THEN learned ELSE a END AS loss FROM x)
        SELECT conv_id, layout, n_turns, sha256(body) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256 FROM y""",
    "op6_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        every AS (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i, len(ws) AS n FROM w),
        e AS (SELECT doc_id, i, n, string_agg(word, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS k FROM every),
        r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS nth FROM e WHERE i <= n - 19),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 19)) AS i FROM r WHERE nth > 1),
        marked AS (SELECT e.*, g.i IS NOT NULL AS out FROM every e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.i = e.i),
        found AS (SELECT doc_id, count(*) FILTER (out) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT out) AS kept FROM marked GROUP BY doc_id)
        SELECT w.doc_id, len(w.ws)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM w LEFT JOIN found f ON f.doc_id = w.doc_id""",
    "op4_minhash_near_dedup": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 4)) AS i FROM w WHERE len(ws) >= 5)
              UNION SELECT doc_id, array_to_string(ws, ' ') FROM w WHERE len(ws) BETWEEN 1 AND 4),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
        r(doc_id, reach) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reach),
        m AS (SELECT doc_id, min(reach) AS component_id FROM r GROUP BY doc_id)
        SELECT m.doc_id, coalesce(n, 0) AS n_shingles, component_id, m.doc_id = component_id AS kept FROM m LEFT JOIN n ON n.doc_id = m.doc_id""",
    "op7_warc": r"""
        WITH h AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS hex FROM pages),
        k AS (SELECT *, min(page_id) OVER (PARTITION BY body) AS first FROM h)
        SELECT page_id, strlen(body) AS payload_bytes,
               array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31)), 1)), '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
        FROM k""",
    "op9_decontamination": r"""
        WITH b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
        bs AS (SELECT item_id, ws, least(10, len(ws)) AS m, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS s FROM b WHERE len(ws) > 0),
        bw AS (SELECT DISTINCT item_id, m, array_to_string(ws[s:s + m - 1], ' ') AS k FROM bs),
        d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
        ds AS (SELECT doc_id, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS s FROM d, (SELECT DISTINCT m FROM bw) WHERE len(ws) >= m),
        hit AS (SELECT doc_id, ds.m, s, item_id FROM ds JOIN bw ON bw.m = ds.m AND bw.k = array_to_string(ws[s:s + ds.m - 1], ' ')),
        cover AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + m - 1)) AS i FROM hit) GROUP BY doc_id),
        found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
        SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cover c ON c.doc_id = d.doc_id LEFT JOIN found f ON f.doc_id = d.doc_id""",
    "op3_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(body) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY body)""",
}
