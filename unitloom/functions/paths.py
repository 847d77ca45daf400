"""Index policy and path-derived names. All paths are relative to the scanned root."""

from pyspark.sql import Column, functions as F

# Fixed values of the index policy.
SKIP_DIRS = [
    "__pycache__", ".git", ".venv", "venv", "node_modules", ".pytest_cache",
    "dist-info", "egg-info", ".tox", ".mypy_cache", "dist", "build", "target",
    ".eggs", "env",
]
SKIP_PACKAGES = ["pip", "setuptools", "wheel", "pkg_resources"]
DOC_DIRS = ["docs", "doc", "documentation"]

# Extension, unit language, language with class refs.
LANGUAGES = [
    (".py", "python", "python"),
    (".rs", "rust", None),
    (".js", "javascript", None),
    (".ts", "typescript", None),
    (".tsx", "tsx", None),
    (".jsx", "tsx", None),
    (".html", "html", None),
    (".htm", "html", None),
]
INDEXABLE = [ext for ext, _, _ in LANGUAGES]


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _rooted(path) -> Column:
    return F.concat(F.lit("/"), _col(path))


def extension(path) -> Column:
    """Lower-cased suffix of the last part; a leading or trailing dot makes none."""
    return F.lower(F.regexp_extract(_col(path), r"[^/](\.[^./]+)$", 1))


def language_of(path) -> Column:
    pairs = [F.lit(x) for ext, lang, _ in LANGUAGES for x in (ext, lang)]
    return F.element_at(F.create_map(*pairs), extension(path))


def ref_language_of(path) -> Column:
    pairs = [F.lit(x) for ext, _, lang in LANGUAGES if lang for x in (ext, lang)]
    return F.element_at(F.create_map(*pairs), extension(path))


def package_name(path, root_name=None, root_is_package=False, below_site_packages=None) -> Column:
    """First folder below site-packages (text before "-"), else a package root's name.

    `below_site_packages` is the root's own path below site-packages ("" if the root
    is that folder), None when the root lies elsewhere.
    """
    if below_site_packages is not None:
        prefix = below_site_packages.strip("/")
        full = F.concat(F.lit(prefix + "/"), _col(path)) if prefix else _col(path)
        return F.regexp_extract(full, r"^([^/-]*)", 1)
    return F.lit(root_name if root_is_package else None).cast("string")


def module_name(package, path) -> Column:
    package = _col(package)
    parts = F.split(_col(path), "/")
    last = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    stem = F.regexp_replace(last, r"(?<=.)\.[^.]+$", "")
    parts = F.when(last == "__init__.py", folders).otherwise(F.concat(folders, F.array(stem)))
    named = F.coalesce(package, F.lit("")) != ""
    inside = F.coalesce(F.get(parts, F.lit(0)) == package, F.lit(False))
    whole = F.when(named & ~inside, F.concat(F.array(package), parts)).otherwise(parts)
    return F.when(F.size(whole) > 0, F.array_join(whole, ".")).otherwise(
        F.when(named, package).otherwise("module")
    )


def looks_like_test(path) -> Column:
    rooted = _rooted(path)
    return rooted.contains("/tests/") | rooted.contains("/test_")


def namespace_class(path, package, package_root=False) -> Column:
    """tests > pip > docs > code; `package_root`: the root is a package or in site-packages."""
    pip = (F.coalesce(_col(package), F.lit("")) != "") & F.lit(package_root)
    docs = F.arrays_overlap(F.split(_col(path), "/"), F.array(*map(F.lit, DOC_DIRS)))
    return (
        F.when(looks_like_test(path), "tests").when(pip, "pip").when(docs, "docs").otherwise("code")
    )


def should_index(path, only_packages=None, package=None) -> Column:
    """Index policy; with an allow-list, `.py` files also need a listed package."""
    rooted = _rooted(path)
    skipped = F.arrays_overlap(F.split(_col(path), "/"), F.array(*map(F.lit, SKIP_DIRS)))
    tool = F.regexp_extract(rooted, r"/site-packages/([^/-]*)", 1).isin(SKIP_PACKAGES)
    keep = (
        extension(path).isin(INDEXABLE)
        & ~skipped
        & ~rooted.contains("/lib64/")
        & ~rooted.contains("/licenses/")
        & ~tool
    )
    if only_packages:
        listed = F.coalesce(_col(package).isin(sorted(only_packages)), F.lit(False))
        keep = keep & ((extension(path) != ".py") | listed)
    return keep


def is_test_hit(path="path", namespace="namespace") -> Column:
    """Test file by path (either slash) or by namespace."""
    rel = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    return (
        rel.contains("/tests/")
        | rel.startswith("tests/")
        | rel.contains("/test_")
        | F.coalesce(_col(namespace) == "tests", F.lit(False))
    )
