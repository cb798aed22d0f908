"""Schemas of the lending tables and of the records that extraction and graph building make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BUSINESS = {
    "category": "category_cd string, category_nm string, upper_category_cd string",
    "book": "book_id string, isbn string, title string, author string, publisher string, publish_date date, category_cd string, location string, loan_yn string, reg_date timestamp_ntz",
    "member": "member_id string, member_nm string, birth_date date, phone string, email string, member_status string, join_date date",
    "loan": "loan_id string, book_id string, member_id string, loan_date date, due_date date, return_date date, loan_status string, extend_cnt int",
    "overdue": "overdue_id string, loan_id string, overdue_start_date date, overdue_days int, release_date date, sanction_status string",
    "loan_hist": "hist_id string, loan_id string, process_type string, process_datetime timestamp_ntz, processor string",
}
ANNOTATION = "struct<name:string,args:map<string,string>>"
CLASSES = (
    "file_path string, package string, class_name string, kind string, layer string, start_line int, end_line int, "
    f"class_annotations array<{ANNOTATION}>, extends string, implements array<string>, "
    "injected_fields array<struct<field_type:string,field_name:string,annotation:string,annotation_args:map<string,string>>>, "
    f"methods array<struct<method_name:string,return_type:string,parameters:array<struct<type:string,name:string>>,start_line:int,end_line:int,annotations:array<{ANNOTATION}>,"
    "url:string,http_methods:array<string>,calls:array<struct<receiver:string,method_name:string,line:int>>,leading_comment:string>>"
)
STATEMENTS = "file_path string, namespace string, sql_id string, sql_type string, start_line int, end_line int, sql_text string, referenced_tables array<string>, result_type string, parameter_type string"
CATALOG = "table_name string, table_comment string, column_name string, data_type string, nullable boolean, default_value string, column_comment string, is_pk boolean, fk_ref_table string, fk_ref_column string, position int"
NODES = "id string, node_type string, class_name string, method_name string, file_path string, start_line int, end_line int, label string, summary string"
EDGES = "src_id string, dst_id string, edge_type string"
NODE_TYPES = ("URL", "CONTROLLER_METHOD", "SERVICE_METHOD", "IMPL_METHOD", "MAPPER_METHOD", "SQL", "TABLE")
EDGE_TYPES = ("HANDLES", "CALLS", "IMPLEMENTS", "EXECUTES", "REFERENCES")


def frame(spark: SparkSession, rows: list, ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, T._parse_datatype_string(ddl)) if isinstance(ddl, str) else spark.createDataFrame(rows, ddl)


def business(spark: SparkSession, data: dict[str, list]) -> dict[str, DataFrame]:
    """The lending tables from rows; tables that are not given are empty."""
    return {name: frame(spark, data.get(name, []), ddl) for name, ddl in BUSINESS.items()}
