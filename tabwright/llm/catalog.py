"""The queries of the text operators and the SQL that has to agree, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import (
    chat, conversation_repair, decontamination, exact_dedup, line_dedup, near_dedup, ngram_lm, pii, prefix_trie, secret_scan, sentencepiece_codec, sharding, toxicity,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_sharding")
def op1(spark, d):
    placed = sharding.shard(table(spark, d, "documents"), 16, seed=20_240_601)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@query("op4_exact_dedup", f"""SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
    doc_id = max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
    FROM (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS body FROM documents)""")
def op4(spark, d):
    return exact_dedup.exact_groups(table(spark, d, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def chat_sql() -> str:
    safe = "replace(replace(replace({0}, '\\', '\\\\'), '<', '<\\'), '[', '[\\')".format
    return f"""WITH turns AS (
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    seen AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before FROM turns)
    SELECT conv_id, count(*) AS n_turns,
        sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
        CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
        sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
        CAST(sum(length({safe('text')}) + CASE WHEN before IS NULL OR before <> role THEN {len(chat.START + chat.BODY + chat.END)} + length({safe('role')})
            ELSE {len(chat.MORE)} END) AS BIGINT) AS formatted_chars
    FROM seen GROUP BY conv_id"""


@query("op6_chat_formatting", chat_sql())
def op6(spark, d):
    given = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.inline(F.array(*[
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(said).alias("text"))
        for i, role in enumerate(("user", "assistant"))
    ])))
    read = chat.read_back(chat.format_chats(given.unionByName(extra)))
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


PIECES = "piece_bpe_32k.model"


@query("op8_sentencepiece")
def op8(spark, d):
    return sentencepiece_codec.encode_decode(table(spark, d, "documents"), public_tokenizers.path(PIECES)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def passages_sql(window: int = decontamination.WINDOW) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
    b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, w, least({window}, len(w)) AS m FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
    bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)),
    dw AS (SELECT r, i, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM b) WHERE len(w) >= m)),
    hit AS (SELECT dw.r, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.g = bw.g),
    marked AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
    items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
        sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN marked USING (r) LEFT JOIN items USING (r)"""


@query("op9_decontamination", passages_sql())
def op9(spark, d):
    found = decontamination.find_passages(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op7_near_dedup")
def op7(spark, d):
    return near_dedup.near_groups(table(spark, d, "documents"), percent=85).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


@query("op5_language_model")
def op5(spark, d):
    docs = table(spark, d, "documents").withColumn("held_out", ngram_lm.held_out())
    model = ngram_lm.train(docs.where("NOT held_out"))
    return ngram_lm.score(docs, model, ("doc_id", "held_out")).select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity"
    )


def toxicity_model(spark: SparkSession, d: str) -> toxicity.Model:
    """Learned from the labelled rows that are not held out."""
    return toxicity.learn(table(spark, d, "documents"), table(spark, d, "labels").where(~toxicity.held_out()))


@query("op10_toxicity")
def op10(spark, d):
    docs = table(spark, d, "documents").withColumn("held_out", toxicity.held_out())
    scored = toxicity.score(docs, toxicity_model(spark, d), ("doc_id", "held_out"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def spans_text(spans: Column, keep=None) -> Column:
    """kind:start:end of each span, comma-joined."""
    spans = F.filter(spans, keep) if keep else spans
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@query("op2_secret_scan")
def op2(spark, d):
    docs = table(spark, d, "documents")
    found = secret_scan.scan(docs, secret_scan.learn(docs))
    base = F.sha2(spans_text(F.col("spans"), lambda s: s["kind"] != "model"), 256)
    return found.select(
        "doc_id", *[counted("spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex")], base.alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"), counted("spans", "model").alias("n_model"),
    )


@query("op3_pii")
def op3(spark, d):
    docs = table(spark, d, "documents")
    found = pii.scan(docs, pii.learn(docs)).withColumn("base", F.filter("spans", lambda s: ~s["added"]))
    return found.select(
        "doc_id", *[counted("base", k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"),
    )


def lines_sql() -> str:
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
    l AS (SELECT r, doc_id, i, lines[i] AS line, translate(trim(lines[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS k
        FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM d)),
    k AS (SELECT k, max(doc_id) AS keeper FROM l WHERE length(k) >= {line_dedup.SHORTEST} GROUP BY k HAVING count(DISTINCT r) >= {line_dedup.LEAST})
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper <> doc_id) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
    FROM l LEFT JOIN k USING (k) GROUP BY r, doc_id"""


@query("op11_line_dedup", lines_sql())
def op11(spark, d):
    return line_dedup.dedup_lines(table(spark, d, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def crc32_sql(text: str) -> str:
    """crc32 of a short ASCII text, bit by bit."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_concat([xor(c, b)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda x, y: {step})"
    return f"""xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(range(1, length({text}) + 1),
        lambda i: CAST(unicode({text}[i]) AS BIGINT))), lambda c, b: {byte}), 4294967295)"""


def repair_sql() -> str:
    """The lattice turn by turn: for each state the cheapest cost (nine digits) and the least audit as one text."""
    def plus(k: str, cost: str, letter: str) -> str:
        return f"lpad(CAST(CAST({k}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {k}[10:] || '{letter}'"

    def stay(k: str, initial: str) -> str:
        return f"CASE WHEN may AND c = '{initial}' THEN {plus(k, 'pen', 'K')} END"

    def turned(k: str) -> str:
        return f"CASE WHEN may THEN {plus(k, '3 + pen', 'R')} END"

    ink = "rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations),
    coded AS (SELECT *, {crc32_sql('id')} % 20 AS m FROM given),
    damaged AS (SELECT conv_id, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN m = 1 THEN '' WHEN m = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
        FROM coded, unnest(range(CASE m WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))),
    ordered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
    marked AS (SELECT *, role[1] AS c, {ink} AS ink, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again,
        lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS c0 FROM ordered),
    judged AS (SELECT *, CASE WHEN ink = '' THEN 1 WHEN again THEN 2 WHEN ink[-1] NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM marked),
    edges AS (SELECT conv_id, i, c, fault NOT IN (1, 2) AS may, CASE fault WHEN 3 THEN 3 ELSE 0 END AS pen FROM judged),
    dp AS (
        SELECT conv_id, CAST(0 AS BIGINT) AS i, '000000000' AS k0, CAST(NULL AS VARCHAR) AS k1, '000000003I' AS k2, '000000006II' AS k3 FROM (SELECT DISTINCT conv_id FROM given)
        UNION ALL
        SELECT conv_id, i, n0, n1, n2, least(n3, {plus('n2', '3', 'I')}) FROM (
            SELECT conv_id, i, n0, n1, least(n2, {plus('n0', '3', 'I')}, {plus('n1', '3', 'I')}, {plus('n3', '3', 'I')}) AS n2, n3 FROM (
                SELECT dp.conv_id, e.i, {plus('k0', '4', 'D')} AS n0, least({plus('k1', '4', 'D')}, {stay('k0', 's')}) AS n1,
                    least({plus('k2', '4', 'D')}, {', '.join(f(k) for k in ('k0', 'k1', 'k3') for f in (lambda k: stay(k, 'u'), turned))}) AS n2,
                    least({plus('k3', '4', 'D')}, {stay('k2', 'a')}, {turned('k2')}) AS n3
                FROM dp JOIN edges e ON e.conv_id IS NOT DISTINCT FROM dp.conv_id AND e.i = dp.i + 1))),
    done AS (SELECT conv_id, i AS n, least(k0, k3) AS k FROM dp QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1),
    letters AS (SELECT conv_id, p, k[9 + p] AS letter FROM done, unnest(range(1, length(k) - 8)) AS u(p)),
    placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS j FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY p)),
    joined AS (SELECT a.*, b.role, b.text, coalesce(max(CASE WHEN a.j = 1 AND letter = 'K' AND b.c = 's' THEN 1 END) OVER (PARTITION BY a.conv_id), 0) AS s
        FROM placed a LEFT JOIN judged b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND a.i = b.i WHERE letter <> 'D'),
    repaired AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' ||
        CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY j)) AS h FROM joined GROUP BY conv_id),
    counts AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
        count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (c0 || c NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv_id)
    SELECT d.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
        coalesce(illegal, 0) AS illegal, CAST(k[1:9] AS BIGINT) AS cost, k[10:] AS audit, coalesce(h, sha256('')) AS repaired_sha256
    FROM done d LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM d.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM d.conv_id"""


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: turns dropped, emptied, cut off, repeated or given another role by their ids."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).cast("int")
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), case.alias("case"))
    text = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        (F.col("case") != 0).alias("present"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("case") == 3, 2).otherwise(1))),
    )


@query("op12_conversation_repair", repair_sql())
def op12(spark, d):
    fixed = conversation_repair.repair(damaged(table(spark, d, "conversations")), present=F.col("present"))
    lines = F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"]))
    return fixed.select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256")
    )


def trie_sql() -> str:
    words = "len(regexp_extract_all({0}, '[^\\x20\\x09-\\x0D]+'))".format
    return f"""WITH own AS (SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS o
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
    coded AS (SELECT *, CAST(conv_id AS VARCHAR) AS id FROM own),
    cut AS (SELECT *, {crc32_sql('id')} % 4 AS h FROM coded),
    built AS (SELECT c.conv_id, list_concat(coalesce(b.o, [])[1:h], c.o[h + 1:]) AS s FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
    member AS (SELECT conv_id, len(s) AS n, d, s[1:d] AS p FROM built, unnest(range(0, len(s) + 1)) AS u(d)),
    node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = d) AS ends FROM member GROUP BY p, d),
    kids AS (SELECT p[1:d - 1] AS q, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1),
    whole AS (SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * {words('p[d].t')} END AS saved FROM node LEFT JOIN kids ON p = q),
    below AS (SELECT p[1:e] AS q, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved) AS saved_tokens FROM whole, unnest(range(0, d + 1)) AS u(e) GROUP BY 1)
    SELECT w.conv_id, w.d AS depth, a.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(w.ends, '')) AS ends_sha256
    FROM whole w JOIN below ON w.p = below.q LEFT JOIN node a ON w.d > 0 AND a.p = w.p[1:w.d - 1]"""


def rebuilt(own: DataFrame) -> DataFrame:
    """Each conversation begins with up to three turns of the first of its twenty."""
    first = own.where(F.col("conv_id") % 20 == 0).select(F.col("conv_id").alias("base"), F.slice("steps", 1, 3).alias("head"))
    rows = own.select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 20).alias("base"), "steps",
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int").alias("h"),
    ).join(first, "base", "left")
    after = F.slice("steps", F.col("h") + 1, F.greatest(F.size("steps"), F.lit(1)))
    return rows.select("conv_id", F.when(F.col("head").isNull(), after).otherwise(F.concat(F.slice("head", F.lit(1), F.col("h")), after)).alias("steps"))


@query("op13_prefix_trie", trie_sql())
def op13(spark, d):
    return prefix_trie.trie(rebuilt(prefix_trie.sequences(table(spark, d, "conversations"))))
