"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annalist.llm import chat, codes, ctw, decontam, exact_dedup, langmix, pagediff, pieces, quality, rope, secrets, setsketch, templates
from annalist.llm.shared import fold, stored, table

PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
HARD_TURN = "\\### Assistant: </turn> ok"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: A document is kept from this score on.
QUALITY_CUT = 0.3


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).select(
        "doc_id",
        (fold(F.col("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"),
    )


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagediff.main_texts(table(spark, sf_dir, "pages"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str = PIECE_MODEL) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pieces.encode(docs, model_path, verify="round_trip")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "round_trip", "ids")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.drop_recurring_lines(table(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_components(table(spark, sf_dir, "documents"), percent=85)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score(table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langmix.identify(docs.select("doc_id", "text"), langmix.fit(docs))
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "lang_pred", "score", "langs", "shares")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.createDataFrame([(-7, 0, "user", HARD_TURN), (-7, 1, "assistant", HARD_TURN)], "conv_id long, turn long, role string, text string")
    out = chat.read_chats(chat.format_chats(turns.unionByName(hard)))
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    books = codes.fit(vectors)
    coded = stored(codes.encode(vectors, books).drop("embedding"), "codes")
    out = codes.total_by(coded, "error", ["label"], "label_error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(books.sha256() if books else None).cast("string").alias("codebooks_sha256"))


def op12_secret_scan(spark: SparkSession, sf_dir: str, vocabulary: str = RANKS) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary).drop("text")
    base = F.filter("secrets", lambda s: s["kind"].isin(*secrets.KINDS[:3]))
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in secrets.KINDS[:3]],
        F.sha2(said(base), 256).alias("base_sha256"),
        said(F.col("secrets")).alias("spans"),
    )


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rope.undo(rope.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_html_extraction": op4_html_extraction,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_line_dedup": op6_line_dedup,
    "op7_minhash_near_dedup": op7_minhash_near_dedup,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_language_id": op9_language_id,
    "op10_chat_format": op10_chat_format,
    "op11_vector_codes": op11_vector_codes,
    "op12_secret_scan": op12_secret_scan,
    "op13_fill_in_middle": op13_fill_in_middle,
}

SQL: dict[str, str] = {
    "op1_exact_dedup": """
        WITH d AS (
            SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
        ), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256
        FROM d JOIN g USING (norm)
    """,
    "op2_decontamination": """
        WITH d AS (
            SELECT doc_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
        ), i AS (
            SELECT DISTINCT item_id, list_filter(string_split(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM benchmark
        ), s AS (
            SELECT item_id, n, k, p, array_to_string(w[p : p + k - 1], ' ') AS sh
            FROM (SELECT item_id, w, len(w) AS n, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS p FROM i WHERE len(w) > 0)
        ), ds AS (
            SELECT doc_id, n, k, p, array_to_string(w[p : p + k - 1], ' ') AS sh
            FROM (SELECT doc_id, w, len(w) AS n, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM s))
        ), win AS (
            SELECT DISTINCT ds.doc_id, s.item_id, s.n, s.k, greatest(1, least(ds.p - s.p + 1, ds.n - s.n + 1)) AS st
            FROM ds JOIN s ON ds.sh = s.sh AND ds.k = s.k
        ), ws AS (
            SELECT win.doc_id, win.item_id, win.n, win.st, ds.sh, row_number() OVER (PARTITION BY win.doc_id, win.item_id, win.n, win.st, ds.sh) AS c
            FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.k = win.k AND ds.p BETWEEN win.st AND win.st + win.n - win.k
        ), si AS (SELECT item_id, n, sh, row_number() OVER (PARTITION BY item_id, n, sh) AS c FROM s),
        na AS (SELECT doc_id, item_id, n, st, count(*) AS na FROM ws GROUP BY ALL),
        nb AS (SELECT item_id, n, count(*) AS nb FROM si GROUP BY ALL),
        both_ AS (SELECT ws.doc_id, ws.item_id, ws.n, ws.st, count(*) AS c FROM ws JOIN si USING (item_id, n, sh, c) GROUP BY ALL),
        sim AS (SELECT doc_id, item_id, n, st, c / (na + nb - c) AS similarity FROM both_ JOIN na USING (doc_id, item_id, n, st) JOIN nb USING (item_id, n)),
        r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, st) AS k FROM sim WHERE similarity >= 0.8)
        SELECT doc_id, item_id, similarity, st AS start_word, n AS n_words FROM r WHERE k = 1
    """,
    "op6_line_dedup": """
        WITH l AS (
            SELECT doc_id, text AS doc, k, lines[k] AS line, trim(regexp_replace(regexp_replace(lines[k], '[0-9]+', '0', 'g'), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), ' ') AS form
            FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS k FROM (SELECT doc_id, coalesce(text, '') AS text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
        ), t AS (SELECT *, CASE WHEN form = '' THEN [] ELSE string_split(form, ' ') END AS tokens FROM l),
        seen AS (SELECT DISTINCT len(tokens) AS n, tokens[1:3] AS lead, form, tokens, doc FROM t WHERE len(tokens) >= 4 OR length(form) >= 40),
        forms AS (SELECT n, lead, form, tokens, count(*) AS docs FROM seen GROUP BY ALL),
        leaves AS (SELECT n, lead, sum(docs) AS total FROM forms GROUP BY ALL HAVING count(*) > 1 AND sum(docs) >= 5),
        met AS (SELECT forms.* , total FROM forms JOIN leaves USING (n, lead)),
        places AS (
            SELECT n, lead, p, tokens[p] AS token, sum(docs) AS docs, any_value(total) AS total
            FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM met) GROUP BY n, lead, p, tokens[p]
        ), modal AS (
            SELECT n, lead, p, token FROM (SELECT *, row_number() OVER (PARTITION BY n, lead, p ORDER BY docs DESC, token DESC) AS k FROM places)
            WHERE k = 1 AND 2 * docs >= total
        ), instances AS (
            SELECT m.n, m.lead, m.form FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM met) m
            LEFT JOIN modal ON m.n = modal.n AND m.lead = modal.lead AND m.p = modal.p AND m.tokens[m.p] = modal.token
            GROUP BY m.n, m.lead, m.form HAVING count(modal.token) / any_value(m.n) >= 0.7
        ), spread AS (
            SELECT n, lead FROM seen JOIN instances USING (n, lead, form) GROUP BY n, lead HAVING count(DISTINCT doc) >= 5
        ), levels AS (SELECT n, lead, p, token, length(bin(CAST(docs // 5 AS BIGINT))) - 1 AS level FROM places WHERE docs >= 5),
        marked AS (
            SELECT m.n, m.lead, m.form, l.p, l.token, l.level FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM met) m
            JOIN levels l ON m.n = l.n AND m.lead = l.lead AND m.p = l.p AND m.tokens[m.p] = l.token
        ), tried AS (
            SELECT k.n, k.lead, k.form, j, list((p, token) ORDER BY p) AS constants
            FROM marked k JOIN (SELECT DISTINCT n, lead, form, level AS j FROM marked) j ON k.n = j.n AND k.lead = j.lead AND k.form = j.form AND k.level >= j.j
            GROUP BY k.n, k.lead, k.form, j HAVING count(*) / k.n >= 0.7
        ), many AS (SELECT n, lead, constants FROM seen JOIN tried USING (n, lead, form) GROUP BY n, lead, constants HAVING count(DISTINCT doc) >= 5),
        gone AS (
            SELECT form FROM forms WHERE docs >= 5 UNION SELECT form FROM instances JOIN spread USING (n, lead) UNION SELECT form FROM tried JOIN many USING (n, lead, constants)
        )
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE gone.form IS NULL), '') AS text,
            count(*) AS n_lines, count(gone.form) AS n_dropped
        FROM t LEFT JOIN gone USING (form) GROUP BY doc_id
    """,
    "op10_chat_format": """
        WITH c AS (
            SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\\### Assistant: </turn> ok'
        ), e AS (
            SELECT *, replace(replace(replace(t, '\\', '\\b'), '###', '\\h'), '</turn>', '\\e') AS te,
                replace(replace(replace(replace(r, '\\', '\\b'), '###', '\\h'), '</turn>', '\\e'), ':', '\\c') AS re,
                row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS k,
                lag(r) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, t) AS before,
                count(*) OVER (PARTITION BY conv_id) AS n
            FROM c
        )
        SELECT conv_id, count(*) AS n_turns,
            sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY k)) AS turns_sha256,
            CAST(sum(CASE WHEN r = 'assistant' THEN length(t) ELSE 0 END) AS BIGINT) AS loss_chars,
            sha256(coalesce(string_agg(t, '' ORDER BY k) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
            CAST(sum(4 + length(re) + 2 + length(te) + 8) AS BIGINT) AS formatted_chars,
            bool_and(CASE WHEN before IS NULL THEN r IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN r = 'user'
                WHEN before = 'user' THEN r = 'assistant' ELSE false END) AND bool_or(k = n AND r = 'assistant') AS valid
        FROM e GROUP BY conv_id
    """,
    "op11_vector_codes": """
        WITH v AS (
            SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
            FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: coalesce(isfinite(x), false))) = len(embedding)
        ), k AS MATERIALIZED (SELECT rid, part, x[part * (len(x) // 16) + 1 : (part + 1) * (len(x) // 16)] AS x FROM (SELECT rid, x, unnest(range(16)) AS part FROM v)),
        c0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x FROM k WHERE rid <= 64),
        a0 AS MATERIALIZED (
            SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
            FROM (SELECT k.rid, k.part, c.entry, list_sum(list_transform(list_zip(k.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM k JOIN c0 c USING (part))
            GROUP BY rid, part
        ), s0 AS (
            SELECT part, entry, p, sum(x[p]) AS s, count(*) AS n
            FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS p FROM k JOIN a0 USING (rid, part)) GROUP BY part, entry, p
        ), m0 AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS x FROM s0 GROUP BY part, entry),
        c1 AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c0 c LEFT JOIN m0 m USING (part, entry)), a1 AS MATERIALIZED (
            SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
            FROM (SELECT k.rid, k.part, c.entry, list_sum(list_transform(list_zip(k.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM k JOIN c1 c USING (part))
            GROUP BY rid, part
        ), s1 AS (
            SELECT part, entry, p, sum(x[p]) AS s, count(*) AS n
            FROM (SELECT part, entry, x, unnest(range(1, len(x) + 1)) AS p FROM k JOIN a1 USING (rid, part)) GROUP BY part, entry, p
        ), m1 AS (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY p) AS x FROM s1 GROUP BY part, entry),
        c2 AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c1 c LEFT JOIN m1 m USING (part, entry)), a2 AS MATERIALIZED (
            SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
            FROM (SELECT k.rid, k.part, c.entry, list_sum(list_transform(list_zip(k.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM k JOIN c2 c USING (part))
            GROUP BY rid, part
        ),
        e AS (SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid),
        t AS (SELECT v.vec_id, v.label, e.code, e.error FROM v JOIN e USING (rid)),
        h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM t, h
    """,
    "op13_fill_in_middle": """
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
        ), r AS (SELECT doc_id, t, n, list_transform(range(4), lambda k: CAST('0x' || h[8 * k + 1 : 8 * k + 8] AS BIGINT)) AS h FROM d),
        f AS (
            SELECT doc_id, t, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                    WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
            FROM r
        ), o AS (SELECT doc_id, t, n, form, a, b, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
            sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
            sha256(t) AS restored_sha256
        FROM o
    """,
}
