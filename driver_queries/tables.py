"""Sources and sinks: whole tables written to the shared folder and read back."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from driver_queries import agreement, survey
from driver_queries.base import CORPUS_SQL, table
from driver_queries.code import METRICS_SQL, parsed, wanted, summary_sql
from logharvest.functions import text as X
from logharvest.operators import calls as C
from logharvest.operators import extraction as E
from logharvest.operators import survey as S
from logharvest.operators.layout import spread
from logharvest.operators.notebooks import broken_notebooks, flatten_notebooks
from logharvest.schemas import ONCE_FILTERED_FILE_CALLS
from logharvest.session import stored, work_folder
from logharvest.plans.agreement import write_kappa_study
from logharvest.sources import code, documents, sinks, tables


def _with_edges(docs):
    """Indented texts that end in line feeds; every ninth is blanks only."""
    text = F.when(F.col("doc_id") % 9 == 0, "  \n \t").otherwise(F.concat(F.lit("    "), "text", F.lit(" \n")))
    return docs.select("doc_id", "lang", text.alias("text"))


def csv_round_trip(spark, sf_dir):
    """Texts with quotes, commas and line breaks through a headed CSV, blanks around them kept."""
    docs = _with_edges(table(spark, sf_dir, "documents"))
    path = work_folder(spark, "csv")
    sinks.write_csv(docs, path)
    back = tables.read_table_csv(spark, path, "doc_id BIGINT, lang STRING, text STRING")
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"))


_DOCUMENTS_SQL = """
SELECT doc_id, lang, md5(CASE WHEN doc_id % 9 = 0 THEN '  ' || chr(10) || ' ' || chr(9)
                              ELSE '    ' || text || ' ' || chr(10) END) AS text_md5 FROM documents"""


def label_csv_round_trip(spark, sf_dir):
    """The same with semicolons."""
    docs = _with_edges(table(spark, sf_dir, "documents"))
    path = work_folder(spark, "labels")
    sinks.write_csv(docs, path, sep=";")
    back = tables.read_table_csv(spark, path, "doc_id BIGINT, lang STRING, text STRING", sep=";")
    return back.select("doc_id", "lang", F.md5("text").alias("text_md5"))


def many_csv(spark, sf_dir):
    """Two headers, united by column name."""
    base = work_folder(spark, "many")
    sinks.write_csv(table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")), f"{base}/one")
    sinks.write_csv(table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").cast("bigint").alias("nation"), F.col("s_name").alias("name")), f"{base}/two")
    return tables.read_many_csv(spark, [f"{base}/one", f"{base}/two"]).withColumn("nation", F.col("nation").cast("bigint"))


def catalogue_parquet(spark, sf_dir):
    return tables.read_catalogue_parquet(spark, f"{sf_dir}/part.parquet")


def json_round_trip(spark, sf_dir):
    """Filtered records through JSON lines, each file's functions written once and put into its calls on reading."""
    path = work_folder(spark, "json")
    data = C.filter_file_calls(E.build_call_dataset(parsed(spark, sf_dir), bodies=False))
    sinks.write_json(data, path, compression="gzip")
    calls = E.explode_calls(E.with_bodies(spark.read.schema(ONCE_FILTERED_FILE_CALLS).json(path)))
    return calls.select("call_key", "snippet_id", "snippet", "library", F.md5("function").alias("function_md5"))


def report_round_trip(spark, sf_dir):
    path = work_folder(spark, "report")
    sinks.write_report(C.summarize_calls(wanted(spark, sf_dir)), path)
    return tables.read_table_csv(spark, path, "section STRING, key STRING, count BIGINT")


def files_by_project(spark, sf_dir):
    """Matched files written by project."""
    path = work_folder(spark, "files")
    sinks.write_files(E.files_with_calls(parsed(spark, sf_dir)), path)
    back = spark.read.parquet(path)
    return back.select("path", F.col("project_name").cast("string"), F.md5("content").alias("content_md5"))


_FILES_SQL = CORPUS_SQL + """
SELECT path, split_part(path, '/', 1) AS project_name, md5(content) AS content_md5
FROM content WHERE doc_id IN (SELECT doc_id FROM calls)"""


def id_lists(spark, sf_dir):
    """Id lists joined for CSV and split again."""
    lists = sinks.join_lists(C.unique_functions(stored(wanted(spark, sf_dir), "calls"), C.SHARDS))
    return lists.select("library", "log_level", X.split_ids("snippet_ids").alias("snippet_id"))


def _write_documents(records, path, opening, closing, sep="\n"):
    """One JSON document per partition, from one text per record; ``sep`` between records' lines."""
    def document(batches):
        # A record is held back until it is known whether a comma follows it.
        previous, comma = opening, ""
        for batch in batches:
            for record in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pydict({"value": [previous + comma]})
                previous, comma = record, ","
        yield pa.RecordBatch.from_pydict({"value": [previous, closing]})

    records.mapInArrow(document, "value STRING").write.option("lineSep", sep).text(path)


def _json_string(column):
    """A text as a JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(column.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def _fields(pad):
    """Role and text of a turn as the indented body of a JSON object."""
    return F.concat(
        F.lit(f'{pad}"function": '), _json_string(F.col("role")),
        F.lit(f',\n{pad}"llm_output": '), _json_string(F.col("text")))


def json_array_records(spark, sf_dir):
    """Conversations as indented arrays, as many files as partitions."""
    turns = spread(table(spark, sf_dir, "conversations"))
    body = F.concat(F.lit('    "conv_id": '), F.col("conv_id").cast("string"), F.lit(",\n"), _fields("    "))
    path = work_folder(spark, "array")
    _write_documents(turns.select(F.concat(F.lit("  {\n"), body, F.lit("\n  }")).alias("value")), path, "[", "]")
    back = documents.read_json_array(spark, path, "conv_id BIGINT, function STRING, llm_output STRING")
    return back.select("conv_id", "function", F.md5("llm_output").alias("output_md5"))


def json_compact_records(spark, sf_dir):
    """Conversations as arrays on one line each, read back by many tasks, whatever the layout."""
    turns = spread(table(spark, sf_dir, "conversations"))
    record = F.to_json(F.struct("conv_id", F.col("role").alias("function"), F.col("text").alias("llm_output")))
    path = work_folder(spark, "compact")
    _write_documents(turns.select(record.alias("value")), path, "[", "]", sep=" ")
    back = documents.read_json_array(spark, path, "conv_id BIGINT, function STRING, llm_output STRING", indent=None)
    return back.select("conv_id", "function", F.md5("llm_output").alias("output_md5"))


def json_map_entries(spark, sf_dir):
    """The same as indented objects keyed by id."""
    turns = spread(table(spark, sf_dir, "conversations"))
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    entry = F.concat(F.lit('  "'), key, F.lit('": {\n'), _fields("    "), F.lit("\n  }"))
    path = work_folder(spark, "map")
    _write_documents(turns.select(entry.alias("value")), path, "{", "}")
    entries = documents.read_json_map(spark, path)
    return entries.select("snippet_id", "function", F.md5("llm_output").alias("output_md5"))


def tree_lines(spark, sf_dir):
    """Documents as text files in folders, read back file by file."""
    path = work_folder(spark, "tree")
    table(spark, sf_dir, "documents").select("source", "lang", "text").write.partitionBy("source", "lang").text(path)
    files = code.read_tree(spark, path, "*.txt")
    lines = files.select(
        F.regexp_extract("path", "source=([^/]*)/lang=([^/]*)/", 1).alias("source"),
        F.explode(X.source_lines("content")).alias("line"))
    return lines.groupBy("source", F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("count"))


def kappa_round_trip(spark, sf_dir):
    """Two annotation files in, kappa file out."""
    base = work_folder(spark, "kappa")
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    sinks.write_csv(docs.select("doc_id", "lang").join(labels, "doc_id").select(
        F.col("doc_id").alias("snippet_id"), F.col("lang").alias("smell"), F.col("quality").alias("Agreement")), f"{base}/a")
    sinks.write_csv(labels.select(
        F.col("doc_id").alias("snippet_id"), (1 - F.col("toxic")).alias("Agreement")), f"{base}/b")
    write_kappa_study(spark, f"{base}/a", f"{base}/b", f"{base}/out")
    return tables.read_table_csv(spark, f"{base}/out/kappa_by_smell", "smell STRING, n_samples BIGINT, kappa DOUBLE")


def survey_csv(spark, sf_dir):
    """The raw survey through CSV, headers with line breaks included."""
    path = work_folder(spark, "survey")
    sinks.write_csv(survey.raw_survey(spark, sf_dir), path)
    raw = tables.read_survey_csv(spark, path, encoding="UTF-8")
    return S.normalize_likert(S.simplify_headers(raw))


def indexed_csv(spark, sf_dir):
    path = work_folder(spark, "indexed")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    sinks.write_index_csv(orders, path, ["o_custkey", "o_orderkey"])
    return tables.read_table_csv(
        spark, path, "index BIGINT, o_custkey BIGINT, o_orderkey BIGINT, o_orderpriority STRING")


def metrics_row(spark, sf_dir):
    """Figures of the data set as one row of CSV."""
    path = work_folder(spark, "metrics")
    sinks.write_metrics_row(C.dataset_metrics(E.build_call_dataset(parsed(spark, sf_dir))), path)
    return tables.read_table_csv(spark, path)


def notebook_tree(spark, sf_dir):
    """Pages as notebooks in folders: every fifth is no notebook; what is read and what is broken."""
    pages = table(spark, sf_dir, "pages")
    cell = F.array(F.struct(F.lit("code").alias("cell_type"), F.array("html").alias("source")))
    book = F.to_json(F.struct(cell.alias("cells"), F.lit(4).alias("nbformat")))
    path = work_folder(spark, "notebooks")
    body = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("{ page "), F.col("page_id").cast("string"))).otherwise(book)

    def write(batches):
        import os

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(path)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system.create_dir(f"{base}/{os.path.dirname(name)}", recursive=True)
                with system.open_output_stream(f"{base}/{name}") as out:
                    out.write(text.encode())
            yield batch.select([0])

    name = F.concat(F.lit("p"), (F.col("page_id") % 7).cast("string"), F.lit("/b"), F.col("page_id").cast("string"), F.lit(".ipynb"))
    stored(pages.select(name.alias("name"), body.alias("body")).mapInArrow(write, "name string"), "written")
    books = code.read_notebook_tree(spark, path)
    number = F.regexp_extract("path", r"/b([0-9]+)\.", 1).cast("bigint").alias("page_id")
    good = flatten_notebooks(books).select(number, F.lit("read").alias("outcome"))
    return good.unionByName(broken_notebooks(books).select(number, F.lit("broken").alias("outcome")))


def _study(spark, sf_dir):
    """The agreement study on integer against floating-point ratings."""
    base = work_folder(spark, "study")
    labels = table(spark, sf_dir, "labels")
    sinks.write_csv(labels.select(F.col("doc_id").alias("snippet_id"), F.col("quality").alias("Agreement")), f"{base}/a")
    sinks.write_csv(labels.select(
        F.col("doc_id").alias("snippet_id"), (1 - F.col("toxic")).cast("double").alias("Agreement")), f"{base}/b")
    write_kappa_study(spark, f"{base}/a", f"{base}/b", f"{base}/out")
    return base


def kappa_metadata(spark, sf_dir):
    base = _study(spark, sf_dir)
    names = [F.regexp_extract(c, "([^/]*)$", 1).alias(c) for c in ("file_a", "file_b")]
    counts = ["rows_file_a", "rows_file_b", "rows_merged_after_join", "rows_with_both_agreement"]
    return tables.read_table_csv(spark, f"{base}/out/metadata").select(*names, *[F.col(c).cast("bigint") for c in counts])


def kappa_disagreements(spark, sf_dir):
    base = _study(spark, sf_dir)
    found = tables.read_table_csv(spark, f"{base}/out/disagreements")
    return found.select(F.col("snippet_id").cast("bigint"), F.col("Agreement_a").cast("double"), F.col("Agreement_b").cast("double"))


def json_documents(spark, sf_dir):
    """Conversations as JSON arrays, a third of the texts null, through the array writer and reader."""
    turns = spread(table(spark, sf_dir, "conversations")).select(
        "conv_id", "turn", F.when(F.col("turn") % 3 != 0, F.col("text")).alias("text"))
    path = work_folder(spark, "documents")
    sinks.write_json_array(turns, path)
    back = documents.read_json_array(spark, path, "conv_id BIGINT, turn BIGINT, text STRING")
    return back.select("conv_id", "turn", F.md5("text").alias("text_md5"))


QUERIES = {
    "metrics_row": (metrics_row, METRICS_SQL),
    "notebook_tree": (
        notebook_tree, "SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'broken' ELSE 'read' END AS outcome FROM pages"),
    "kappa_metadata": (
        kappa_metadata,
        """SELECT 'a' AS file_a, 'b' AS file_b, count(*) AS rows_file_a, count(*) AS rows_file_b,
                  count(*) AS rows_merged_after_join, count(*) AS rows_with_both_agreement FROM labels"""),
    "kappa_disagreements": (
        kappa_disagreements,
        """SELECT doc_id AS snippet_id, CAST(quality AS DOUBLE) AS "Agreement_a", CAST(1 - toxic AS DOUBLE) AS "Agreement_b"
           FROM labels WHERE quality <> 1 - toxic"""),
    "json_documents": (
        json_documents,
        "SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN md5(text) END AS text_md5 FROM conversations"),
    "tree_lines": (
        tree_lines,
        """WITH l AS (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents)
           SELECT source, md5(line) AS line_md5, count(*) AS count FROM l GROUP BY 1, 2"""),
    "kappa_round_trip": (kappa_round_trip, agreement._LABELS_SQL + agreement._KAPPA_SQL + agreement._BY_SELECT),
    "survey_csv": (survey_csv, survey._CLEAN_SQL + "SELECT * FROM s"),
    "indexed_csv": (
        indexed_csv,
        """SELECT row_number() OVER (ORDER BY o_custkey, o_orderkey) - 1 AS index, o_custkey, o_orderkey, o_orderpriority
           FROM orders"""),
    "csv_round_trip": (csv_round_trip, _DOCUMENTS_SQL),
    "label_csv_round_trip": (label_csv_round_trip, _DOCUMENTS_SQL),
    "many_csv": (
        many_csv,
        """SELECT c_name AS name, c_acctbal AS balance, NULL::BIGINT AS nation FROM customer
           UNION ALL SELECT s_name, NULL, s_nationkey FROM supplier"""),
    "catalogue_parquet": (catalogue_parquet, "SELECT * FROM part"),
    "json_round_trip": (
        json_round_trip,
        CORPUS_SQL + "SELECT call_key, snippet_id, snippet, library, md5(function) AS function_md5 FROM wanted"),
    "report_round_trip": (report_round_trip, summary_sql("library")),
    "files_by_project": (files_by_project, _FILES_SQL),
    "json_array_records": (
        json_array_records,
        "SELECT conv_id, role AS function, md5(text) AS output_md5 FROM conversations"),
    "json_compact_records": (
        json_compact_records,
        "SELECT conv_id, role AS function, md5(text) AS output_md5 FROM conversations"),
    "json_map_entries": (
        json_map_entries,
        "SELECT conv_id || '-' || turn AS snippet_id, role AS function, md5(text) AS output_md5 FROM conversations"),
    "id_lists": (
        id_lists,
        CORPUS_SQL + """SELECT library, log_level, snippet_id FROM (SELECT DISTINCT library,
          CASE WHEN library = 'logging' THEN coalesce(nullif(regexp_extract(snippet, '^logging\\.([a-z]+)\\(', 1), ''), 'unknown') END AS log_level,
          snippet_id, call_key FROM wanted)"""),
}
