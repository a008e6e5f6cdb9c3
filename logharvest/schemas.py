"""Schemas of the stored tables, as Spark DDL."""

from __future__ import annotations

REPO_STATUS = "repository_full_name STRING, status_code INT, archived BOOLEAN"

FILES = "path STRING, content STRING"

SNIPPET = (
    "STRUCT<snippet_id: STRING, snippet: STRING, "
    "context: STRUCT<class: STRING, function_name: STRING, function: STRING, "
    "lines_before: STRING, lines_after: STRING>, line_number: INT>"
)

FILE_CALLS = (
    "id STRING, project_name STRING, file_path STRING, library STRING, library_type STRING, "
    f"python_file_content STRING, snippets ARRAY<{SNIPPET}>"
)

FILTERED_FILE_CALLS = f"library STRING, library_type STRING, snippets ARRAY<{SNIPPET}>"

# As written here: calls carry their whole digest too.
KEYED_SNIPPET = SNIPPET.replace("STRUCT<", "STRUCT<call_key: STRING, ", 1)
KEYED_FILTERED_FILE_CALLS = FILTERED_FILE_CALLS.replace(SNIPPET, KEYED_SNIPPET)

# The same with each function once per file, calls with its number (``extraction.with_bodies``).
ONCE_SNIPPET = KEYED_SNIPPET.replace(" function: STRING", " function_ix: INT")
ONCE_FILTERED_FILE_CALLS = FILTERED_FILE_CALLS.replace(SNIPPET, ONCE_SNIPPET) + ", functions ARRAY<STRING>"

FRAMEWORK_MATCHES = (
    "repository_full_name STRING, matched_framework STRING, matched_term STRING, "
    "matched_file_name STRING, matched_file_path STRING, priority INT"
)

LABEL_ENTRY = "STRUCT<function: STRING, llm_output: STRING>"

SMELL = "STRUCT<smell: STRING, rationale: STRING, confidence: STRING>"

# What the parser reports for one source file.
FILE_FACTS = (
    "STRUCT<status: STRING, n_functions: INT, n_classes: INT, "
    "imported: MAP<STRING, STRING>, "
    "functions: ARRAY<STRUCT<name: STRING, first: INT, last: INT>>, "
    "calls: ARRAY<STRUCT<line: INT, end_line: INT, library: STRING, text: STRING, "
    "function_ix: INT, class_name: STRING>>>"
)
