"""What several tests of the text operators share."""

FOLDER = "/root/testdata/sf0.001"


def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id")
