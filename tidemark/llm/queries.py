"""The registered queries of the corpus operators, each over its whole table, and SQL twins where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tidemark.llm import ann, bpe, codes, common, exact_dedup, exact_search, html, importance, mixing, pii, quality, simhash, substrings, urls


def op1_pfair_mix(spark, sf_dir):
    mix = mixing.mixed(common.table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mix.select("doc_id", "mix_source", "mix_block", "mix_slot", "mix_position")


def op2_learned_partitions(spark, sf_dir):
    return ann.learned_partition_search(common.table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, 20)


def op3_simhash(spark, sf_dir):
    found = simhash.near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op4_contextual_pii(spark, sf_dir):
    found = pii.spans(common.table(spark, sf_dir, "documents"))
    counts = [pii.count_of("base", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    base = F.sha2(pii.as_text(F.col("base")), 256).alias("base_sha256")
    every = F.concat("base", "found")
    return found.select("doc_id", *counts, base, pii.as_text(every).alias("spans"), F.size(every).cast("long").alias("n_spans"), F.col("discovered").alias("n_discovered"))


def op5_host_reputation(spark, sf_dir):
    # The labelled outcomes of pages: a bad one is of low quality or toxic.
    labels = common.table(spark, sf_dir, "labels")
    outcomes = labels.select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return urls.judge(common.table(spark, sf_dir, "pages"), outcomes)


def op6_main_text(spark, sf_dir):
    return html.extract(common.table(spark, sf_dir, "pages"))


def op7_exact_top_k(spark, sf_dir):
    return exact_search.exact_top_k(common.table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, 5)


def op8_repeated_passages(spark, sf_dir):
    found = substrings.repeated_passages(common.table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select("doc_id", "n_words", gone.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op9_bpe(spark, sf_dir):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(common.table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op10_line_field(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.train(docs, common.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_importance_resampling(spark, sf_dir):
    return importance.resampled(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op12_ball_tree_codes(spark, sf_dir):
    return codes.product_codes(common.table(spark, sf_dir, "embeddings"))


def op13_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_duplicates(spark, f"{sf_dir}/documents.parquet")


def _codes_sql() -> str:
    """Each round's assignment and next codebook by comparing every part with every entry."""
    assigned = """
        a{k} AS MATERIALIZED (
            SELECT rid, p, min({{'d': CAST(xx - 2 * list_inner_product(x, y) + yy AS BIGINT), 'e': e}}) AS m
            FROM q JOIN (SELECT *, list_inner_product(y, y) AS yy FROM b{k}) USING (p) GROUP BY rid, p
        )"""
    next_book = """
        u{n} AS (SELECT p, m.e AS e, unnest(range(len(x))) AS i, unnest(x) AS c FROM a{k} JOIN q USING (rid, p)),
        f{n} AS (SELECT p, e, i, CAST(sum(c) AS BIGINT) AS s, count(*) AS n FROM u{n} GROUP BY ALL),
        g{n} AS (SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS z FROM f{n} GROUP BY p, e),
        b{n} AS MATERIALIZED (SELECT p, e, coalesce(z, y) AS y FROM b{k} LEFT JOIN g{n} USING (p, e))"""
    rounds = ",".join(assigned.format(k=k) + "," + next_book.format(k=k, n=k + 1) for k in range(4))
    return f"""
        WITH v AS (
            SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ),
        q AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (SELECT rid, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM v, range(4) r(p))),
        b0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS y FROM q WHERE rid <= 256),{rounds},{assigned.format(k=4)},
        h AS (SELECT sha256(string_agg(t, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (SELECT p, e, array_to_string(list_transform(y, lambda c: CAST(c AS BIGINT)), ',') AS t FROM b4)),
        o AS (SELECT rid, string_agg(format('{{:02x}}', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a4 GROUP BY rid)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN o USING (rid), h"""


QUERIES = {
    "op1_pfair_mix": op1_pfair_mix,
    "op2_learned_partitions": op2_learned_partitions,
    "op3_simhash": op3_simhash,
    "op4_contextual_pii": op4_contextual_pii,
    "op5_host_reputation": op5_host_reputation,
    "op6_main_text": op6_main_text,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_bpe": op9_bpe,
    "op10_line_field": op10_line_field,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_ball_tree_codes": op12_ball_tree_codes,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLE_SQL = {
    "op7_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
            FROM v a JOIN v b ON a.vec_id <> b.vec_id AND a.vec_id % 50 = 0
        ), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "op8_repeated_passages": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS s FROM t WHERE len(w) >= 50),
        h AS (SELECT doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) AS h FROM p),
        f AS (SELECT h, min(doc_id) AS lo FROM h GROUP BY h HAVING min(doc_id) < max(doc_id)),
        g AS (SELECT h.doc_id, list(h.s) AS starts FROM h JOIN f USING (h) WHERE lo < h.doc_id GROUP BY h.doc_id),
        c AS (SELECT doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) AS gone FROM g),
        k AS (
            SELECT t.doc_id, len(w) AS n, coalesce(len(gone), 0) AS g,
                   CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END AS kept
            FROM t LEFT JOIN c USING (doc_id)
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(g AS BIGINT) AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""",
    "op5_host_reputation": r"""
        WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
        p AS (
            SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
                   coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u
        ),
        o AS (
            SELECT host, CAST(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END AS BIGINT) AS bad
            FROM p JOIN labels ON page_id = doc_id WHERE host <> ''
        ),
        hd0 AS (SELECT DISTINCT host, regexp_replace(host, ':[0-9]*$', '') AS bare FROM p WHERE host <> ''),
        hd1 AS (SELECT *, string_split(bare, '.') AS l, regexp_matches(bare, '^[0-9]{1,3}(\.[0-9]{1,3}){3}$') AS address FROM hd0),
        hd2 AS (SELECT *, regexp_matches(l[-1], '^[a-z]{2}$') AND list_contains(['ac', 'co', 'com', 'edu', 'go', 'gov', 'mil', 'ne', 'net', 'or', 'org', 'sch'], coalesce(l[-2], l[-1])) AS long FROM hd1),
        hd AS (
            SELECT host, CASE WHEN address THEN bare WHEN long THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END AS domain,
                   CASE WHEN address THEN 'ip' WHEN long THEN array_to_string(l[-2:], '.') ELSE l[-1] END AS suffix FROM hd2
        ),
        h AS (SELECT host, domain, suffix, count(bad) AS n, sum(bad) AS bad FROM o JOIN hd USING (host) WHERE bad IS NOT NULL GROUP BY ALL),
        d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL),
        s AS (SELECT suffix, 0 AS top, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
        c AS (
            SELECT 'top' AS level, CAST(top AS VARCHAR) AS parent, n, bad FROM s
            UNION ALL SELECT 'suffix', suffix, n, bad FROM d UNION ALL SELECT 'domain', domain, n, bad FROM h
        ),
        m AS (
            SELECT level, parent, CAST(sum(n) AS DOUBLE) AS sn, CAST(sum(bad) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS rate,
                   CAST(count(*) AS DOUBLE) AS m, sum(CAST(bad AS DOUBLE) * bad / n) AS sq, CAST(sum(n * n) AS DOUBLE) AS nn FROM c GROUP BY ALL
        ),
        v AS (
            SELECT level, parent, rate * (1 - rate) AS spread,
                   CASE WHEN sn - nn / sn > 0 AND sq - sn * rate * rate - (m - 1) * rate * (1 - rate) > 0
                        THEN (sq - sn * rate * rate - (m - 1) * rate * (1 - rate)) / (sn - nn / sn) END AS var FROM m
        ),
        k AS (SELECT level, parent, round(CASE WHEN var IS NULL OR spread <= 0 THEN 500.0 ELSE least(greatest(spread / var - 1, 2.0), 500.0) END, 3) AS k FROM v),
        ms AS (
            SELECT suffix, (bad + k * (SELECT sum(bad) / sum(n) FROM s)) / (n + k) AS mu FROM s JOIN k ON level = 'top'
        ),
        md AS (SELECT domain, (d.bad + k * mu) / (d.n + k) AS mu FROM d JOIN ms USING (suffix) JOIN k ON level = 'suffix' AND parent = d.suffix),
        pd AS (SELECT domain, mu, k FROM md JOIN k ON level = 'domain' AND parent = domain),
        ps AS (SELECT suffix, mu, k FROM ms JOIN k ON level = 'suffix' AND parent = suffix),
        pt AS (SELECT (SELECT sum(bad) / sum(n) FROM s) AS mu, CASE WHEN (SELECT count(*) FROM s) < 2 THEN 2.0 ELSE k END AS k FROM k WHERE level = 'top'),
        b AS (
            SELECT hd.host, n, bad, coalesce(bad, 0) + coalesce(pd.k, ps.k, pt.k) * coalesce(pd.mu, ps.mu, pt.mu) AS a,
                   coalesce(n, 0) - coalesce(bad, 0) + coalesce(pd.k, ps.k, pt.k) * (1 - coalesce(pd.mu, ps.mu, pt.mu)) AS b
            FROM hd LEFT JOIN h USING (host) LEFT JOIN pd ON pd.domain = hd.domain LEFT JOIN ps ON ps.suffix = hd.suffix LEFT JOIN pt ON true
        ),
        r AS (SELECT *, a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > 0.35 AS blocked FROM b),
        f AS (
            SELECT p.*, n, bad, blocked, CASE
                WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
                WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
                WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
                WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
            FROM p LEFT JOIN r USING (host)
        )
        SELECT page_id, host, path, rule,
               CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict,
               CAST(coalesce(n, 0) AS BIGINT) AS n_labelled, CAST(coalesce(bad, 0) AS BIGINT) AS n_bad
        FROM f""",
    "op11_importance_resampling": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        df AS (SELECT doc_id, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
        bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
        k AS (SELECT list(c ORDER BY i) AS t FROM (
            SELECT i, list_reduce(range(8), lambda c, j: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) AS c FROM range(256) r(i)
        )),
        h AS MATERIALIZED (
            SELECT f, xor(list_reduce(
                list_transform(range(CAST(octet_length(encode(f)) AS BIGINT)), lambda i: CAST('0x' || substr(hex(encode(f)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
                lambda c, x: xor(t[CAST(xor(c % 256, x) AS BIGINT) + 1], c // 256), 4294967295), 4294967295) % 10000 AS bucket
            FROM (SELECT f FROM df UNION SELECT f FROM bf), k
        ),
        x AS MATERIALIZED (SELECT doc_id, bucket, count(*) AS n FROM df JOIN h USING (f) GROUP BY ALL),
        s AS (SELECT bucket, sum(n) AS s FROM x GROUP BY bucket),
        t AS (SELECT bucket, count(*) AS t FROM bf JOIN h USING (f) GROUP BY bucket),
        g AS (
            SELECT bucket, CAST(floor(1000 * ln(
                CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST((SELECT sum(s) FROM s) + 10000 AS DOUBLE)
                / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM bf) + 10000 AS DOUBLE)))) AS BIGINT) AS gain
            FROM s FULL JOIN t USING (bucket)
        ),
        m AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS total FROM x JOIN g USING (bucket) GROUP BY doc_id),
        e AS (
            SELECT doc_id, len(w) AS words, coalesce(n_features, 0) AS n_features, CASE WHEN n_features > 0 THEN CAST((total - ((total % n_features) + n_features) % n_features) // n_features AS BIGINT) ELSE 0 END AS weight,
                   CAST('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) AS u
            FROM d LEFT JOIN m USING (doc_id)
        ),
        r AS (SELECT doc_id, words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((u + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM e),
        o AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM r WHERE words >= 20)
        SELECT r.doc_id, n_features, weight, score, CASE WHEN k <= 25 * n // 100 THEN CAST(k AS BIGINT) END AS rank FROM r LEFT JOIN o USING (doc_id)""",
    "op12_ball_tree_codes": _codes_sql(),
    "op13_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
}
