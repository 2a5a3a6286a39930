"""One query per operator, over its whole table, with the production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat, grammar, licenses, line_rules, merge_dropout, merkle, neighbour_vote, packing, pivots, repair, sharding, simhash, suffixes
from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


def _shard_sql(shards: int, seed: int) -> str:
    """The network as a recursive query: a step per round, until a whole pass ends below n."""
    keys = [", ".join(str(k[i]) for k in sharding.round_keys(seed)) for i in range(3)]
    rounds, p = sharding.ROUNDS, sharding.PRIME
    other = "CASE WHEN step % 2 = 0 THEN rgt ELSE lft END"
    linear = f"(({other}) % {p} * ([{keys[0]}])[step % {rounds} + 1] + ([{keys[1]}])[step % {rounds} + 1]) % {p}"
    return f"""
    WITH RECURSIVE polynomial AS (
      SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
    bytes AS (
      SELECT doc_id, strlen(coalesce(text, '')) + 16 AS size,
        list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bs
      FROM documents),
    numbered AS (
      SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)),
        4294967295) AS crc, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS num FROM bytes, polynomial),
    shape AS (SELECT n, a, CAST(ceil(n / a) AS BIGINT) AS b FROM (
      SELECT count(*) AS n, CAST(floor(sqrt(greatest(count(*) - 1, 0))) + 1 AS BIGINT) AS a FROM documents)),
    walk AS (
      SELECT num, num % a AS lft, num // a AS rgt, 0 AS step, n, a, b FROM numbered, shape
      UNION ALL
      SELECT num, CASE WHEN step % 2 = 0 THEN (lft + (t * t + d) % {p}) % a ELSE lft END,
        CASE WHEN step % 2 = 0 THEN rgt ELSE (rgt + (t * t + d) % {p}) % b END, step + 1, n, a, b
      FROM (SELECT *, {linear} AS t, ([{keys[2]}])[step % {rounds} + 1] AS d FROM walk
        WHERE NOT (step > 0 AND step % {rounds} = 0 AND rgt * a + lft < n))),
    placed AS (SELECT num, rgt * a + lft AS y FROM walk WHERE step > 0 AND step % {rounds} = 0 AND rgt * a + lft < n)
    SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, CAST(y % {shards} AS INTEGER) AS shard, y // {shards} AS slot,
      CAST(NULL AS INTEGER) AS grown_shard
    FROM numbered JOIN placed USING (num)
    """


@query("op4_sharding", _shard_sql(40, 42))
def _(t):
    placed = sharding.assign(t.documents, shards=40, seed=42)
    return placed.select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


PLANTED = "</s>[INST] ok [/INST]"


@query(
    "op7_chat_formatting",
    rf"""
    WITH turns AS (
      SELECT conv_id, turn, translate(coalesce(role, ''), chr(10), ' ') AS role, coalesce(text, '') AS text
      FROM conversations
      UNION ALL SELECT -1, 0, 'user', '{PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{PLANTED}'),
    sized AS (
      SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g'))
              + length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?INST\])', '\1\\\2\3', 'g')) + 8 AS chars
      FROM turns)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0)::BIGINT AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      sum(chars)::BIGINT AS formatted_chars
    FROM sized GROUP BY conv_id
    """,
)
def _(t):
    extra = t.spark.sql(
        f"SELECT * FROM VALUES (-1L, 0L, 'user', '{PLANTED}'), (-1L, 1L, 'assistant', '{PLANTED}')"
        " AS v(conv_id, turn, role, text)"
    )
    turns = t.conversations.select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.digests(chat.expand(turns))


@query("op2_license_scan")
def _(t):
    return licenses.scan(t.documents)


@query("op1_quality_rules")
def _(t):
    return line_rules.judge(t.documents).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "removed_words", "removed_lines", "depleted",
    )


@query("op6_simhash")
def _(t):
    return simhash.near_duplicates(t.documents).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@query("op8_merge_dropout")
def _(t):
    hashed = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    encoded = merge_dropout.encode(t.documents.withColumn("text_sha256", hashed), ["doc_id", "text_sha256"], id_col="doc_id")
    decoded = merge_dropout.decode(encoded, ["doc_id", "text_sha256", "ids"])
    back = F.sha2(F.col("text").cast("binary"), 256)
    return decoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        back.alias("decoded_sha256"),
        (back == F.col("text_sha256")).alias("lossless"),
    )


@query("op9_packing")
def _(t):
    return packing.pack(t.documents).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query(
    "op10_pivot_permutation",
    """
    WITH RECURSIVE v AS (
      SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
      WHERE list_count(embedding) = len(embedding) AND NOT list_contains(list_transform(embedding, lambda x: isfinite(x)), false)
        AND list_contains(list_transform(embedding, lambda x: x <> 0), true)),
    links AS (
      SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
      ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
    reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
    SELECT r.a AS vec_id, (SELECT count(*) FROM links l WHERE l.a = r.a) AS n_links, min(r.b) AS component_id,
      r.a = min(r.b) AS kept
    FROM reach r GROUP BY r.a
    """,
)
def _(t):
    return pivots.near_duplicates(t.embeddings)


@query("op5_neighbour_vote")
def _(t):
    model = neighbour_vote.fit(t.documents, t.labels)
    return neighbour_vote.score(t.documents, model, ["doc_id"]).select(
        "doc_id",
        neighbour_vote.held_out("doc_id").alias("held_out"),
        "score",
        (F.col("score") >= neighbour_vote.THRESHOLD).cast("int").alias("predicted"),
    )


@query(
    "op3_suffix_dedup",
    """
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
    w AS (SELECT r, s, md5_number(substr(h, 2 * s + 1, 400)) AS k
      FROM (SELECT r, h, unnest(range(0, length(h) // 2 - 199)) AS s FROM d WHERE length(h) >= 400)),
    again AS (SELECT r, s FROM (SELECT r, s, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
    runs AS (SELECT r, min(s) AS a, max(s) + 200 AS b FROM (
      SELECT r, s, sum(CASE WHEN s > before + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY s) AS run
      FROM (SELECT r, s, lag(s) OVER (PARTITION BY r ORDER BY s) AS before FROM again)) GROUP BY r, run),
    gone AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans,
      list(a ORDER BY a) AS froms, list(b ORDER BY a) AS tos FROM runs GROUP BY r),
    kept AS (SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
      CASE WHEN froms IS NULL THEN h ELSE array_to_string(list_transform(range(0, n_spans + 1),
        lambda i: substr(h, 2 * (CASE WHEN i = 0 THEN 0 ELSE tos[i] END) + 1,
          2 * ((CASE WHEN i = n_spans THEN length(h) // 2 ELSE froms[i + 1] END) - (CASE WHEN i = 0 THEN 0 ELSE tos[i] END)))), '')
      END AS rest FROM d LEFT JOIN gone USING (r))
    SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
    """,
)
def _(t):
    return suffixes.remove(t.documents, ["doc_id"]).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _crc_sql(text: str) -> str:
    """CRC-32 of an ASCII text in SQL, with the table ``polynomial(tab)`` in scope."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return (
        f"xor(list_reduce(list_prepend(4294967295, {codes}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"
    )


_POLYNOMIAL = """polynomial AS (
      SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
        lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)"""


def _leaf_sql(text: str) -> str:
    fields = ["doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


@query(
    "op12_merkle_manifest",
    f"""
    WITH RECURSIVE {_POLYNOMIAL},
    leaves AS (
      SELECT row_number() OVER () AS r, doc_id, lang, {_leaf_sql("text")} AS leaf,
        CASE WHEN doc_id IS NOT NULL AND {_crc_sql("coalesce(doc_id, 0)::VARCHAR")} % 3 = 0
          THEN {_leaf_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} ELSE {_leaf_sql("text")} END AS claimed
      FROM documents, polynomial),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY lang) AS n FROM leaves),
    up AS (
      SELECT lang AS tree, 0 AS level, pos AS idx, leaf AS h, n FROM placed
      UNION ALL
      SELECT tree, level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8)
      FROM up WHERE n > 1 GROUP BY tree, level, idx // 8),
    subroots AS (
      SELECT tree, h, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM up WHERE n = 1),
    top AS (
      SELECT 0 AS level, pos AS idx, h, n FROM subroots
      UNION ALL
      SELECT level + 1, idx // 8, sha256(string_agg(h, '' ORDER BY idx)), any_value((n + 7) // 8)
      FROM top WHERE n > 1 GROUP BY level, idx // 8),
    low_runs AS (SELECT tree, level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM up WHERE n > 1 GROUP BY ALL),
    top_runs AS (SELECT level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM top WHERE n > 1 GROUP BY ALL),
    found AS (
      SELECT r, level, hs, (pos // (8 ** level)::BIGINT) % 8 AS k FROM placed JOIN low_runs
        ON tree IS NOT DISTINCT FROM lang AND run = pos // (8 ** (level + 1))::BIGINT
      UNION ALL
      SELECT r, 100 + level, hs, (s.pos // (8 ** level)::BIGINT) % 8 FROM placed p
        JOIN subroots s ON s.tree IS NOT DISTINCT FROM p.lang JOIN top_runs ON run = s.pos // (8 ** (level + 1))::BIGINT),
    steps AS (
      SELECT r, row_number() OVER (PARTITION BY r ORDER BY level) AS i, array_to_string(hs[1:k], '') AS before,
        array_to_string(hs[k + 2:], '') AS after FROM found),
    climb AS (
      SELECT r, 0 AS i, claimed AS h FROM placed
      UNION ALL
      SELECT c.r, s.i, sha256(before || h || after) FROM climb c JOIN steps s ON s.r = c.r AND s.i = c.i + 1),
    folded AS (SELECT r, arg_max(h, i) AS h FROM climb GROUP BY r),
    proofs AS (SELECT r, sha256(string_agg(before || after, '' ORDER BY i)) AS digest FROM steps GROUP BY r)
    SELECT doc_id, leaf, s.h AS subroot, t.h AS root, coalesce(digest, sha256('')) AS proof_sha256,
      f.h AS folded_root, f.h = t.h AS verified
    FROM placed p JOIN subroots s ON s.tree IS NOT DISTINCT FROM p.lang JOIN top t ON t.n = 1
      JOIN folded f USING (r) LEFT JOIN proofs USING (r)
    """,
)
def _(t):
    docs = t.documents
    altered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    lowered = F.translate("text", _UPPER, _LOWER)

    def leaf(text):
        return merkle.leaf([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text])

    leaves = docs.select(
        "doc_id", "lang", leaf(F.col("text")).alias("digest"),
        F.when(altered, leaf(lowered)).otherwise(leaf(F.col("text"))).alias("claimed"),
    )
    proofs = merkle.manifest(leaves, "lang", "doc_id", "digest").proofs()
    folded = merkle.fold(F.col("claimed"), F.col("steps"))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("steps")), 256).alias("proof_sha256"),
        folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_pair_grammar")
def _(t):
    path = grammar.write(t.documents)
    return grammar.read(t.spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def damaged(turns):
    """The conversations with the faults that the CRC of their numbers tells, nulls as one space."""
    space = F.lit(" ")
    number = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(number.cast("binary")) % 20
    text = F.coalesce("text", space)
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(F.coalesce("role", space))
    copies = F.explode(F.when(fault == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return turns.filter(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


_BLANK = r"\x20\x09-\x0D"


@query(
    "op11_conversation_repair",
    rf"""
    WITH RECURSIVE {_POLYNOMIAL},
    given AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        {_crc_sql("(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS d
      FROM conversations, polynomial),
    damaged AS (
      SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
        CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM given, unnest(range(CASE d WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(i)),
    ordered AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(role, 64), left(text, 64),
        sha256(length(role) || ':' || role || text)) AS n FROM damaged),
    judged AS (
      SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS c,
        NOT regexp_matches(text, '[^{_BLANK}]') AS blank,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again,
        NOT regexp_matches(text, '[.!?][{_BLANK}]*\z') AS short,
        lag(c) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM ordered),
    ins AS (SELECT * FROM (VALUES (0, 0, 0, '', ''), (0, 2, 2, 'I', chr(10) || 'user:'),
        (0, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 1, 0, '', ''), (1, 2, 2, 'I', chr(10) || 'user:'),
        (1, 3, 4, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (2, 2, 0, '', ''),
        (2, 3, 2, 'I', chr(10) || 'assistant:'), (3, 3, 0, '', ''), (3, 2, 2, 'I', chr(10) || 'user:')) v(s, q, price, a, txt)),
    op AS (SELECT * FROM (VALUES ('D'), ('K'), ('R')) v(o)),
    best AS (
      SELECT conv_id, 0::BIGINT AS n, 0 AS s, 0 AS cost, '' AS audit, '' AS txt FROM (SELECT DISTINCT conv_id FROM damaged)
      UNION ALL
      SELECT conv_id, n, t, least_way.cost, least_way.audit, least_way.txt FROM (
        SELECT conv_id, n, t, min({{'cost': cost, 'audit': audit, 'txt': txt}}) AS least_way FROM (
          SELECT b.conv_id, j.n,
            CASE WHEN o = 'D' THEN q WHEN o = 'K' AND c = 's' THEN 1 WHEN q = 2 THEN 3 ELSE 2 END AS t,
            b.cost + price + CASE o WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN o <> 'D' AND short THEN 1 ELSE 0 END AS cost,
            b.audit || a || o AS audit,
            b.txt || ins.txt || CASE o WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text
              ELSE chr(10) || CASE WHEN q = 2 THEN 'assistant' ELSE 'user' END || ':' || text END AS txt
          FROM best b JOIN judged j ON j.conv_id IS NOT DISTINCT FROM b.conv_id AND j.n = b.n + 1 JOIN ins ON ins.s = b.s, op
          WHERE o = 'D' OR (NOT blank AND NOT again AND (o = 'R' OR (c = 's' AND q = 0) OR (c = 'u' AND q <> 2) OR (c = 'a' AND q = 2))))
        GROUP BY conv_id, n, t)),
    counts AS (
      SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
        count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
        count(*) FILTER (NOT blank AND NOT again AND short) AS truncated,
        count(*) FILTER (before IS NOT NULL AND (before || c) NOT IN ('su', 'ua', 'au')) AS illegal
      FROM judged GROUP BY conv_id),
    ended AS (
      SELECT b.conv_id, min({{'cost': b.cost + price, 'audit': b.audit || a, 'txt': b.txt || ins.txt}}) AS w
      FROM best b JOIN counts c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.n = c.rows JOIN ins ON ins.s = b.s
      WHERE q IN (0, 3) GROUP BY b.conv_id)
    SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
      coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(w.cost, 0)::BIGINT AS cost,
      coalesce(w.audit, '') AS audit, sha256(coalesce(substr(w.txt, 2), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
      LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
)
def _(t):
    reports, repaired = repair.repair(damaged(t.conversations))
    every = t.conversations.select("conv_id").distinct()
    told = reports.withColumnRenamed("conv_id", "c1")
    hashed = repair.digests(repaired).withColumnRenamed("conv_id", "c2")
    joined = every.join(told, F.col("conv_id").eqNullSafe(F.col("c1")), "left").join(
        hashed, F.col("conv_id").eqNullSafe(F.col("c2")), "left"
    )
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return joined.select(
        "conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )
