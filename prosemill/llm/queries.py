"""The opN_<name> queries: thin contracts over the operators of this subpackage."""

from __future__ import annotations

import corpus_pipeline

from .common import table


def op1_token_files(spark, sf_dir):
    """Every whole text as token ids in PFOR shards, reported from the files."""
    from .tokens import token_files

    return token_files(spark, table(spark, sf_dir, "documents"))


def op2_pitman_yor(spark, sf_dir):
    """Hierarchical Pitman-Yor scores of every whole text, learnt outside the held-out fold."""
    from .pitman_yor import score

    return score(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark, sf_dir):
    """Classes of documents with 2-word shingle similarity of 0.8 or more."""
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op4_quality_classifier(spark, sf_dir):
    """Co-trained text and metadata views: scores of every document."""
    from .cotrain import score_documents

    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_url_filter(spark, sf_dir):
    """Every capture against the list entries active on its fetch date."""
    from .urls import dated, demo_list, filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(dated(pages), demo_list(pages))


def op6_decontamination(spark, sf_dir):
    """Benchmark items found in each whole document."""
    from .decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark, sf_dir):
    """Bytes left after removing every repeated 200-byte string of the whole collection."""
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), length=200)


def op8_mixing(spark, sf_dir):
    """Documents taken, by epoch, for the target weights of the domain-language-source tree."""
    from .mixing import LEVELS, WEIGHTS, mix

    taken = mix(table(spark, sf_dir, "documents"), LEVELS, WEIGHTS)
    return taken.select("doc_id", taken.mix_path[0].alias("domain"), taken.mix_path[1].alias("language"), taken.mix_path[2].alias("source"), taken.mix_tokens.alias("n_tokens"), taken.mix_epoch.alias("epoch"))


def op9_personal_data(spark, sf_dir):
    """Pattern spans and disclosing terms of every whole text."""
    from pyspark.sql import functions as F

    from .privacy import KINDS, find_private, span_list

    found = find_private(table(spark, sf_dir, "documents"))
    counts = [F.size(f"s_{k}").cast("long").alias(f"n_{k}") for k in [*KINDS, "term"]]
    return found.select("doc_id", *counts[:4], F.sha2(span_list(list(KINDS)), 256).alias("base_sha256"), span_list([*KINDS, "term"]).alias("spans"), counts[4])


def op10_quality_rules(spark, sf_dir):
    """Base counts and divergence from the language references, for every document."""
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark, sf_dir):
    """Codes of every vector by codebooks fitted over all of them."""
    from .codes import vector_codes

    return vector_codes(table(spark, sf_dir, "embeddings"))


def op12_centroids(spark, sf_dir):
    """Clusters of every 64-component vector, fitted over different vectors with weights."""
    from .centroids import cluster

    return cluster(table(spark, sf_dir, "embeddings"))


def op13_warc_records(spark, sf_dir):
    """Every page as a WARC record in zip-packaged archives, reported from byte ranges of them."""
    from .warc import warc_records

    return warc_records(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = [op1_token_files, op2_pitman_yor, op3_near_duplicates, op4_quality_classifier, op5_url_filter, op6_decontamination, op7_suffix_dedup, op8_mixing, op9_personal_data, op10_quality_rules, op11_vector_codes, op12_centroids, op13_warc_records]


def queries() -> dict:
    return {f.__name__: f for f in QUERIES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    from . import centroids, codes, urls, warc

    return {"op5_url_filter": urls.SQL, "op11_vector_codes": codes.SQL, "op12_centroids": centroids.SQL, "op13_warc_records": warc.SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
