"""Source files of a repository as rows, with their path-derived context."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from unitloom.functions import paths
from unitloom.session import spread
from unitloom.sources import listing


def spark_glob(extensions: list) -> str:
    """A file name pattern that matches the extensions in either case."""
    return "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e[1:]) for e in extensions) + "}"


def read_repository(spark: SparkSession, root: str, extensions: list = paths.INDEXABLE, complete: bool = True) -> DataFrame:
    """path (relative to root) and raw bytes of every regular file with one of `extensions`.

    Names that start with `_` or `.` are read too; folders that the index policy skips are not entered.
    That needs a root that Python tasks can open: a path mounted on all of them or an Arrow file system.
    With `complete` off Spark's own file source reads any store that Spark reads, without such names.
    """
    if complete:
        return listing.read_files(listing.list_files(spark, root, extensions, paths.SKIP_DIRS), root)
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", spark_glob(extensions))
        .load(root)
    )
    return relative_paths(spread(files), root)


def root_context(spark: SparkSession, root: str) -> dict:
    """Package facts of a scanned root, as `file_context` takes them.

    The nearest `site-packages` folder at or above the root holds packages; a root with an
    `__init__.py` is a package itself.
    """
    parts = [p for p in root.split("://", 1)[-1].split("/") if p]
    below = None
    if "site-packages" in parts:
        place = len(parts) - 1 - parts[::-1].index("site-packages")
        below = "/".join(parts[place + 1 :])
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/__init__.py")
    is_package = marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)
    return {"root_name": parts[-1] if parts else None, "root_is_package": is_package, "below_site_packages": below}


def relative_paths(files: DataFrame, root: str) -> DataFrame:
    base = root.rstrip("/") + "/"
    plain = F.regexp_replace("path", r"^[a-zA-Z][\w+.-]*:(//[^/]*)?(?=/)", "")
    base = base.split("://", 1)[-1] if "://" in base else base
    base = "/" + base.split("/", 1)[-1] if not base.startswith("/") else base
    inside = F.substring(plain, F.lit(len(base) + 1), F.length(plain))
    return files.select(inside.alias("path"), F.col("content").alias("source"))


def decode(source) -> Column:
    """Bytes as text, invalid sequences replaced."""
    source = F.col(source) if isinstance(source, str) else source
    return F.make_valid_utf8(source.cast("string"))


def source_lines(text) -> Column:
    """Lines of a file; the line break at the very end starts no further line."""
    text = F.col(text) if isinstance(text, str) else text
    whole = F.when(text.endswith("\n"), F.left(text, F.length(text) - 1)).otherwise(text)
    plain = F.split(whole, "\n")
    return F.when(text.contains("\r"), F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")).otherwise(plain)


def line_rows(files: DataFrame) -> DataFrame:
    """path, line_no (1-based), text."""
    return files.select("path", F.posexplode(source_lines("text")).alias("pos", "text")).select(
        "path", (F.col("pos") + 1).alias("line_no"), "text"
    )


def file_context(
    files: DataFrame, *, root_name: str | None = None, root_is_package: bool = False,
    below_site_packages: str | None = None, only_packages: set | None = None,
) -> DataFrame:
    """Indexable files with language, package, module and namespace. No shuffle."""
    package = paths.package_name("path", root_name, root_is_package, below_site_packages)
    in_package_root = root_is_package or below_site_packages is not None
    return (
        files.withColumn("package", package)
        .filter(paths.should_index("path", only_packages, F.col("package")))
        .withColumns(
            {
                "language": paths.language_of("path"),
                "module": paths.module_name("package", "path"),
                "namespace": paths.namespace_class("path", "package", in_package_root),
            }
        )
    )
