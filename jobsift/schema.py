"""Columns of the pipeline's tables."""

from __future__ import annotations

from pyspark.sql import types as T

POSTING_COLUMNS = (
    "posting_id company_id company_name city company_area salary education experience description position_name title headcount publish_date industry source"
).split()
RAW = T.StructType([T.StructField(c, T.StringType()) for c in POSTING_COLUMNS])
SCREENED = T.StructType([*RAW.fields, T.StructField("date", T.StringType()), T.StructField("shard", T.StringType())])
ATTRIBUTE_COLUMNS = [c for c in POSTING_COLUMNS if c != "description"]
DESCRIPTION_COLUMNS = ["posting_id", "company_id", "description"]
LABELLED_COLUMNS = ["posting_id", "description", "title", "soc_code"]
CROSSWALK_CODE = "2018 SOC Code"
