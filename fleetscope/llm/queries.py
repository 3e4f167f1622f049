"""The registered query of every operator of this package: whole tables, production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetscope.llm.decontamination import contaminated
from fleetscope.llm.exact_dedup import exact_dedup
from fleetscope.llm.html_text import extract_text
from fleetscope.llm.jaccard_join import jaccard_groups
from fleetscope.llm.language_id import predict, train
from fleetscope.llm.license_scan import license_scan
from fleetscope.llm.line_dedup import line_dedup
from fleetscope.llm.mixing import mix_sources
from fleetscope.llm.ngram_model import score
from fleetscope.llm.ngram_model import train as train_ngrams
from fleetscope.llm.packing import pack
from fleetscope.llm.spelling import lettered_words, misspelt, spelling_variants, word_counts
from fleetscope.llm.vector_codes import vector_codes
from fleetscope.llm.warc import round_trip
from fleetscope.session import scratch_path

#: Words in a run of the scoring model: a word is judged by the two before it.
ORDER = 3

LLM_RUNS = {}
LLM_ORACLES = {}


def llm_query(name: str, oracle: str | None = None):
    def register(function):
        def run(spark, sf_dir):
            return function(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        LLM_RUNS[name] = run
        if oracle:
            LLM_ORACLES[name] = oracle
        return function

    return register


def id_checksum(remainder_of: int):
    """crc32 of doc_id as text, modulo a number."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % remainder_of


@llm_query("op1_lm_scoring")
def op1(table):
    docs = table("documents").select("doc_id", "text")
    model = train_ngrams(docs.where(id_checksum(10) != 0), order=ORDER)
    columns = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return score(docs, model).select("doc_id", (id_checksum(10) == 0).alias("held_out"), *columns)


@llm_query("op2_license_scan")
def op2(table):
    return license_scan(table("documents"))


@llm_query(
    "op3_line_dedup",
    r"""
    WITH split AS (
      SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
    ), lines AS (
      SELECT doc_id, unnest(parts) AS line, unnest(range(1, len(parts) + 1)) AS pos FROM split
    ), keyed AS (
      SELECT doc_id, pos, line, translate(
        regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
    ), dropped AS (
      SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10
    )
    SELECT k.doc_id, count(*) AS n_lines, count(d.key) AS n_dropped,
           sha256(coalesce(string_agg(CASE WHEN d.key IS NULL THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
    FROM keyed k LEFT JOIN dropped d ON k.key = d.key GROUP BY k.doc_id
    """,
)
def op3(table):
    out = line_dedup(table("documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return out.select("doc_id", "n_lines", "n_dropped", kept.alias("kept_sha256"))


@llm_query("op4_language_id")
def op4(table):
    docs = table("documents").select("doc_id", "text", "lang")
    model = train(docs.where(id_checksum(4) != 2))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (id_checksum(4) == 2).alias("held_out"), "lang_pred", "score")


@llm_query("op5_decontamination")
def op5(table):
    return contaminated(table("documents"), table("benchmark"))


@llm_query("op6_html_text")
def op6(table):
    return extract_text(table("pages"))


@llm_query("op7_jaccard_join")
def op7(table):
    return jaccard_groups(table("documents"))


@llm_query(
    "op8_warc",
    r"""
    WITH payloads AS (
      SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
    ), digests AS (
      SELECT page_id, octet_length(payload) AS payload_bytes, sha256(payload) AS payload_digest FROM payloads
    ), firsts AS (
      SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM digests
    )
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
    FROM firsts
    """,
)
def op8(table):
    pages = table("pages")
    records = round_trip(pages, scratch_path(pages.sparkSession, "warc"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@llm_query(
    "op9_exact_dedup",
    r"""
    WITH texts AS (
      SELECT doc_id, length(coalesce(text, '')) AS points,
             sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
    ), ranked AS (
      SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
             count(*) OVER (PARTITION BY text_sha256) AS group_size FROM texts
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM ranked
    """,
)
def op9(table):
    return exact_dedup(table("documents"))


@llm_query("op10_mix_sources")
def op10(table):
    return mix_sources(table("documents")).select("doc_id", "size", "source_size", "target", "taken", F.col("copies"))


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The quantiser in DuckDB: one table of assignments and one of codebooks for each round."""
    steps = [
        f"""kept AS MATERIALIZED (
          SELECT row_number() OVER () AS rid, vec_id, label, [CAST(floor(1024 * x) AS BIGINT) for x in embedding] AS v
          FROM embeddings WHERE embedding IS NOT NULL
          AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0)""",
        f"""parts AS MATERIALIZED (
          SELECT rid, vec_id, p, list_slice(v, p * (len(v) // {parts}) + 1, (p + 1) * (len(v) // {parts})) AS part
          FROM kept, range({parts}) AS t(p))""",
        f"""book0 AS MATERIALIZED (
          SELECT p, dense_rank() OVER (ORDER BY vec_id, rid) - 1 AS e, part FROM parts
          QUALIFY e < {entries})""",
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""near{i} AS MATERIALIZED (
              SELECT rid, p, any_value(a.part) AS part, min(struct_pack(d := list_sum(
                [(t[1] - t[2]) * (t[1] - t[2]) for t in list_zip(a.part, b.part)]), e := b.e)) AS best
              FROM parts a JOIN book{i} b USING (p) GROUP BY rid, p)"""
        )
        if i < rounds:
            steps.append(
                f"""mean{i} AS MATERIALIZED (
                  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS part FROM (
                    SELECT p, best.e AS e, j, sum(x) AS s, count(*) AS n FROM (
                      SELECT p, best, unnest(part) AS x, unnest(range(len(part))) AS j FROM near{i}) GROUP BY ALL)
                  GROUP BY p, e)"""
            )
            steps.append(
                f"""book{i + 1} AS MATERIALIZED (
                  SELECT p, e, coalesce(m.part, b.part) AS part FROM book{i} b LEFT JOIN mean{i} m USING (p, e))"""
            )
    return f"""
    WITH {", ".join(steps)}, coded AS (
      SELECT rid, string_agg(lower(printf('%02x', best.e)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
      FROM near{rounds} GROUP BY rid
    ), digest AS (
      SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM (
        SELECT p, e, unnest(part) AS x, unnest(range(len(part))) AS j FROM book{rounds})
    )
    SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
    FROM kept JOIN coded USING (rid), digest
    """


@llm_query("op11_vector_codes", _codes_sql())
def op11(table):
    return vector_codes(table("embeddings"))


@llm_query("op12_spelling_variants")
def op12(table):
    words = misspelt(lettered_words(table("documents"), "doc_id", "text"), 97)
    return spelling_variants(word_counts(words, min_length=5, min_count=3))


@llm_query("op13_best_fit_packing")
def op13(table):
    import public_tokenizers

    out = pack(table("documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.drop("ids")
