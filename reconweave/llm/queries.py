"""The registered corpus queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reconweave.llm import exact_dedup, language_id, licenses, mixing, near_dedup, packing, pii, prefix_trie, quality, sharding, spelling, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), with_ids=False)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(language_id.of_documents(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(language_id.of_pages(_table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(_table(spark, sf_dir, "documents"), k=4, percent=80)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"), shards=24)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_table(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing,
        op2_exact_dedup,
        op3_language_id,
        language_id_pages,
        op4_pii,
        op5_mixing,
        op6_warc,
        op7_near_dedup,
        op8_licenses,
        op9_quality,
        op10_sharding,
        op11_prefix_trie,
        op12_toxicity,
        op13_spelling,
    )
}


def _license_sql() -> str:
    rows = licenses.template_rows(licenses.TEMPLATES, licenses.THRESHOLD)
    quote = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    values = ", ".join("(" + ", ".join(map(quote, row)) + ")" for row in rows)
    scale = round(licenses.THRESHOLD * 1000)
    anchors = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in licenses.window_rows(licenses.TEMPLATES,
        licenses.anchor_words(rows, licenses.THRESHOLD)))
    inside = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in licenses.contained(licenses.TEMPLATES))
    return rf"""
        WITH t(template, n_template, least, most, bigram) AS (VALUES {values}),
        d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        p AS (
            SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t]+', '\1' || chr(10), 'g'), chr(10))) AS piece FROM d
            UNION ALL SELECT doc_id, unnest(string_split_regex(text, '\n[ \t\r]*\n')) FROM d
            UNION ALL SELECT doc_id, text FROM d
        ),
        q AS (SELECT doc_id, string_split(trim(regexp_replace(lower(piece), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM p),
        x AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM d),
        o AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM x),
        z AS (SELECT DISTINCT doc_id, greatest(i - place, 0) AS start, n FROM o JOIN (VALUES {anchors}) AS a(word, place, n) USING (word)),
        w AS (SELECT doc_id, row_number() OVER () AS pos, w FROM (SELECT * FROM q UNION ALL SELECT doc_id, x.w[z.start + 1:z.start + z.n] FROM z
            JOIN x USING (doc_id)) AS u),
        b AS (SELECT doc_id, pos, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM w),
        e AS (SELECT doc_id, pos, len(b) AS n, unnest(b) AS bigram FROM b),
        c AS (
            SELECT doc_id, pos, n, template, n_template, count(*) AS c FROM e JOIN t USING (bigram)
            GROUP BY ALL HAVING c * 2000 >= {scale} * (n + n_template)
        ),
        h AS (
            SELECT doc_id, template, round(2 * c / (n + n_template), 6) AS score FROM c
            QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY round(2 * c / (n + n_template), 6) DESC, template) = 1
        ),
        g AS (SELECT doc_id, template, max(score) AS score FROM h GROUP BY doc_id, template),
        s AS (SELECT * FROM g WHERE NOT EXISTS (SELECT 1 FROM g AS b JOIN (VALUES {inside}) AS i(part, whole) ON b.template = whole
            WHERE b.doc_id = g.doc_id AND part = g.template)),
        f AS (
            SELECT doc_id, string_agg(template, ',' ORDER BY template) AS licenses, max(score) AS best_score, count(*) AS n_licenses,
                   first(template ORDER BY score DESC, template) AS best
            FROM s GROUP BY doc_id
        )
        SELECT doc_id, licenses, best, best_score, coalesce(n_licenses, 0) AS n_licenses FROM d LEFT JOIN f USING (doc_id)
    """


#: CRC-32 in SQL: a table of 256 steps of eight bits, and a fold over a text's bytes as numbers (Latin-1 letters are two bytes).
_CRC_TABLE = """
    crc_bits(b, k, x) AS (
        SELECT b, 0, b::BIGINT FROM range(256) AS r(b)
        UNION ALL SELECT b, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM crc_bits WHERE k < 8
    ),
    crc_table AS (SELECT list(x ORDER BY b) AS t FROM crc_bits WHERE k = 8)"""


def _crc(text: str) -> str:
    codes = f"list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] ELSE [195, ord(c)::BIGINT - 64] END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten({codes})), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


_TRIE_SQL = f"""
    WITH RECURSIVE {_CRC_TABLE},
    c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
                 octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '') AS turn,
                 octet_length(encode(coalesce(text, ''))) AS bytes
          FROM conversations WHERE conv_id IS NOT NULL),
    k AS (SELECT conv_id, {_crc('conv_id::VARCHAR')} % 9 AS h FROM (SELECT DISTINCT conv_id FROM c) AS i, crc_table),
    r AS (SELECT k.conv_id, 0 AS own, pos, turn, bytes FROM k JOIN c ON c.conv_id = k.conv_id - k.conv_id % 5 WHERE pos < h
          UNION ALL SELECT conv_id, 1, pos, turn, bytes FROM k JOIN c USING (conv_id) WHERE pos >= h),
    p AS (SELECT conv_id, row_number() OVER w AS depth, sha256(string_agg(sha256(turn), '') OVER w) AS name, bytes
          FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos ROWS UNBOUNDED PRECEDING)
          UNION ALL SELECT conv_id, 0, '', 0 FROM k),
    n AS (SELECT name, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY name),
    e AS (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id),
    f AS (SELECT name, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids FROM e JOIN p USING (conv_id, depth) GROUP BY name),
    u AS (SELECT n.name, q.name AS parent FROM n JOIN p AS q ON q.conv_id = n.conv_id AND q.depth = n.depth - 1),
    x AS (SELECT parent AS name, count(*) AS n_children FROM u GROUP BY parent),
    a AS (SELECT n.name AS low, q.name FROM n JOIN p AS q ON q.conv_id = n.conv_id AND q.depth <= n.depth),
    s AS (SELECT a.name, count(*) FILTER (WHERE x.name IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.bytes) AS saved_tokens
          FROM a JOIN n ON n.name = a.low LEFT JOIN x ON x.name = a.low GROUP BY a.name)
    SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
           saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
    FROM n JOIN s ON s.name = n.name LEFT JOIN x ON x.name = n.name LEFT JOIN f ON f.name = n.name
    LEFT JOIN u ON u.name = n.name LEFT JOIN n AS q ON q.name = u.parent
"""

_SPELLING_SQL = rf"""
    WITH RECURSIVE {_CRC_TABLE},
    r AS (SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
    o AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
          FROM r WHERE length(run) >= 7 GROUP BY ALL),
    h AS (SELECT run, n, {_crc("id || ':' || run")} AS h FROM o, crc_table),
    v AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
    w AS (SELECT word, sum(n)::BIGINT AS n FROM v WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    d AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM w, unnest(range(1, length(word) + 1)) AS t(i)),
    near AS (
        SELECT a.word, b.word AS other, b.n AS other_n FROM d AS a JOIN d AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT a.word, b.word, b.n FROM w AS a JOIN d AS b ON a.word = b.rest
        UNION SELECT b.word, a.word, a.n FROM w AS a JOIN d AS b ON a.word = b.rest
    ),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word),
    f AS (SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form,
                 CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
          FROM w LEFT JOIN best USING (word)),
    way(word, spot, step) AS (
        SELECT word, word, 0 FROM f UNION ALL SELECT way.word, f.form, step + 1 FROM way JOIN f ON f.word = way.spot WHERE f.form IS NOT NULL
    ),
    ends AS (SELECT word, max_by(spot, step) AS root FROM way GROUP BY word)
    SELECT word, form, root, n, n_near, form_n FROM f JOIN ends USING (word)
"""

ORACLE_SQL = {
    "op11_prefix_trie": _TRIE_SQL,
    "op13_spelling": _SPELLING_SQL,
    "op2_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        ), g AS (
            SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text_sha256
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text_sha256)
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        g AS (SELECT html, max(page_id) AS top FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
        SELECT page_id, octet_length(encode(p.html)) AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN top <> page_id THEN top END AS refers_to
        FROM p LEFT JOIN g ON p.html = g.html
    """,
    "op8_licenses": _license_sql(),
}
