"""Extractors by language; a caller can add a language or replace one.

An extractor takes a DataFrame with `language`, `text` and `lines` and adds one column
with the file's units: array<struct<start_line, end_line, symbol, class_chain, role,
calls, doc, refs>>, NULL for files of other languages. The content is not part of it: it is
the range of lines, taken row by row. Class refs are part of the struct, so a ref extractor is a
function that fills or replaces `refs` there; only units that may have refs keep them.
"""

from pyspark.sql import DataFrame, functions as F

from unitloom.functions.texts import REF_ROLES
from unitloom.operators.extract import brace_units, html_units, python_units

# column name -> (languages, function)
EXTRACTORS = {
    "python": (["python"], python_units.extract),
    "script": (brace_units.SCRIPT_LANGUAGES, brace_units.extract_scripts),
    "rust": (["rust"], brace_units.extract_rust),
    "html": (["html"], html_units.extract),
}
REF_EXTRACTORS = {}


def register_language(column: str, languages: list, extract) -> None:
    EXTRACTORS[column] = (languages, extract)


def register_refs(language: str, refs) -> None:
    """`refs(unit Column) -> map<string,string> Column` for units with a class chain."""
    REF_EXTRACTORS[language] = refs


def extract_all(df: DataFrame, languages: list | None = None) -> DataFrame:
    """Adds `found`, the units of each file, from the extractors of `languages`."""
    used = []
    for column, (mine, extract) in EXTRACTORS.items():
        if languages is None or set(mine) & set(languages):
            df = extract(df)
            used.append(column)
    df = df.withColumn("found", F.coalesce(*used)).drop(*used)
    for language, refs in REF_EXTRACTORS.items():
        eligible = lambda u: u["role"].isin(REF_ROLES) & (F.size(u["class_chain"]) > 0)
        replaced = F.transform("found", lambda u: u.withField("refs", F.when(eligible(u), refs(u)).otherwise(u["refs"])))
        df = df.withColumn("found", F.when(F.col("language") == language, replaced).otherwise(F.col("found")))
    return df
