"""The engine's tables made from the tables of a folder, as SQL that both Spark and other engines read.

The prose of the given documents names no gene, so abstracts get a sentence that
their id chooses; the same text goes into the queries and into their SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

BASE = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

SENTENCES = {
    0: " A mutation c.123A>G in BRCA1 was associated with disease; rs12345 and p.Val600Glu were found.",
    1: " Serum IL6 and TNF-alpha, a cytokine biomarker, were elevated in HIV1 infection.",
    2: " This systematic review covers public health policy and nursing.",
    3: " HLA-B*27:05 was typed among HLA class I alleles such as A*02. IFN-gamma and MMP-9 rose. L858R in EGFR.",
    4: " Overexpression of EGFR and loss of PTEN; knockout of TP53 in the pathway, p < 0.05.",
    5: " Table 2 lists 12.5 and 40 units; the figure shows results.",
}

TABLES = {
    "papers": "SELECT doc_id, CAST(doc_id AS STRING) AS pmid, lang, source, n_chars, "
    "CASE WHEN doc_id % 9 = 0 THEN 'BRCA1 and TP53 in a cohort ' WHEN doc_id % 5 = 0 THEN 'Gene expression and MYC2 ' ELSE 'Study ' END || CAST(doc_id AS STRING) AS title, "
    "text || CASE doc_id % 8 " + " ".join(f"WHEN {k} THEN '{s}'" for k, s in SENTENCES.items()) + " ELSE '' END AS abstract, "
    "'The Journal of ' || upper(lang) || '!' AS journal, CASE WHEN doc_id % 4 = 0 THEN '1234-567' || CAST(doc_id % 10 AS STRING) END AS issn, "
    "CASE WHEN doc_id % 7 = 0 THEN 'N/A' ELSE CAST(1990 + doc_id % 35 AS STRING) END AS year, "
    "CAST(CASE WHEN doc_id % 13 = 0 THEN NULL ELSE doc_id END AS INT) AS search_rank, (doc_id * 37) % 400 AS raw_citations FROM documents",
    "primary_counts": "SELECT CAST(doc_id AS STRING) AS pmid, CAST(CASE WHEN doc_id % 6 = 0 THEN NULL ELSE (doc_id * 37) % 400 END AS INT) AS count FROM documents WHERE doc_id % 3 <> 1",
    "secondary_counts": "SELECT CAST(doc_id AS STRING) AS pmid, CAST((doc_id * 11) % 90 AS INT) AS count, doc_id % 5 <> 0 AS ok FROM documents WHERE doc_id % 4 <> 1",
    "lexicon": "SELECT * FROM (VALUES (0, 'BRCA1', 'RNF53,BRCC1', 'protein'), (1, 'TP53', 'P53,LFS1', 'protein'), (2, 'TNF', 'TNF-ALPHA,TNFA', 'protein'), "
    "(3, 'IL6', 'IL-6,BSF2,P53', 'protein'), (4, 'EGFR', 'ERBB,HER1', 'protein'), (5, 'PTEN', 'MMAC1', 'protein'), (6, 'MMP9', 'CLG4B', 'protein'), (7, 'IFNG', 'IFG', 'protein')) AS t(ordinal, symbol, names, locus_type)",
    "labels_given": "SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'p53' WHEN 1 THEN 'il-6' WHEN 2 THEN 'Tnf alpha' WHEN 3 THEN 'EGFR' WHEN 4 THEN 'egfrx' ELSE '' END AS label FROM documents",
    "variants_given": "SELECT doc_id, CASE doc_id % 16 WHEN 0 THEN 'p.Val600Glu' WHEN 1 THEN 'p.V600E' WHEN 2 THEN 'L858R' WHEN 3 THEN 'c.123A>G' WHEN 4 THEN 'IVS2+1' WHEN 5 THEN 'exon 19 deletion' "
    "WHEN 6 THEN 'c.35delG' WHEN 7 THEN 'rs12345' WHEN 8 THEN 'N/A' WHEN 9 THEN 't(9;22)(q34;q11)' WHEN 10 THEN 'b27:05' WHEN 11 THEN 'CN=3' WHEN 12 THEN 'del(5q)' WHEN 13 THEN 'p.Lys5fs' WHEN 14 THEN '' ELSE 'unclear' END AS variant, "
    "CASE WHEN doc_id % 16 = 10 THEN 'HLA-B' ELSE 'EGFR' END AS gene, doc_id % 3 <> 0 AS valid_gene FROM documents",
    "rows_given": "SELECT doc_id, doc_id AS position, CAST(doc_id % 97 AS STRING) AS pmid, CASE doc_id % 4 WHEN 0 THEN 'BRCA1' WHEN 1 THEN 'tp53 ' WHEN 2 THEN 'EGFR' ELSE '' END AS gene, "
    "CASE doc_id % 3 WHEN 0 THEN 'L858R' WHEN 1 THEN 'n/a' ELSE 'T790M' END AS variant, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'finding ' || CAST(doc_id % 2 AS STRING) END AS finding, "
    "CASE WHEN doc_id % 7 < 3 THEN NULL ELSE 'quote ' || CAST(doc_id % 3 AS STRING) END AS quote, doc_id % 2 = 0 AS quote_valid, (doc_id % 11) / 10.0 AS validation_confidence, "
    "CASE doc_id % 5 WHEN 0 THEN 'llm_text' WHEN 1 THEN 'deterministic_lexicon' WHEN 2 THEN 'llm_figure' WHEN 3 THEN 'pubtator' ELSE '' END AS source, "
    "CASE WHEN doc_id % 6 = 0 THEN 'skeleton' ELSE 'llm' END AS extraction_mode, CASE WHEN doc_id % 12 = 0 THEN '429 RESOURCE_EXHAUSTED' ELSE '' END AS error, "
    "CASE doc_id % 4 WHEN 0 THEN 'both' ELSE 'llm' END AS gene_source, CASE doc_id % 9 WHEN 0 THEN 'variant_association' WHEN 1 THEN 'animal_model_gene' WHEN 2 THEN 'biomarker_gene' WHEN 3 THEN 'figure_derived_gene' ELSE 'candidate_gene' END AS association_type FROM documents",
    "slots": "SELECT event_id, user_id, ts, event_type, value, CAST(user_id % 50 AS STRING) AS pmid, 'run' || CAST(date_trunc('day', ts) AS STRING) AS run_id FROM events",
}


def sql_with(names: list[str], query: str) -> str:
    """A query with the named tables as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({TABLES[n]})" for n in names) + " " + query


#: Tables of texts below this size come in fewer row groups than there are cores, and are dealt out before expensive expressions.
SMALL_BYTES = 24 << 20
_TEXTS = ("documents", "pages")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if name not in _TEXTS or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > SMALL_BYTES:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, from the session's setting; where that is unset a local session gets the warehouse, and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    master = spark.sparkContext.master
    if not root and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = root or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Rows that several results are made of, written to the shared folder once and read again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table of a folder."""
    query = TABLES[name]
    for b in BASE:
        query = query.replace(f"FROM {b}", f"FROM {{{b}}}")
    used = {b: base(spark, sf_dir, b) for b in BASE if f"{{{b}}}" in query}
    return spark.sql(query, **used) if used else spark.sql(query)
