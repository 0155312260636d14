"""Finding and describing source files: scan, pruning, language, size and line figures, and repository addresses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.text import clean_path

# Folders that a scan leaves out, in any letter case; so does any folder whose name starts with ".git".
IGNORED_FOLDERS = (
    ".git node_modules __pycache__ .venv venv dist build coverage .next .nuxt target vendor .turbo .gradle .idea .vscode bin obj .tox eggs .mypy_cache .pytest_cache .ruff_cache .cache out"
).split()
# Suffixes of files that are no text.
IGNORED_SUFFIXES = (
    ".exe .dll .so .dylib .bin .pyc .pyo .pyd .class .jar .war .wasm .o .obj .a .lib .png .jpg .jpeg .gif .ico .svg .webp .bmp .tiff .mp4 .mov .avi .mkv .mp3 .wav .flac "
    ".zip .tar .gz .7z .rar .bz2 .tgz .pdf .doc .docx .xls .xlsx .ppt .pptx .woff .woff2 .ttf .eot .otf"
).split()
# Languages by suffix and by whole file name.
LANGUAGE_SUFFIXES = {
    "Python": ".py .pyi", "JavaScript": ".js .mjs .cjs .jsx", "TypeScript": ".ts .mts .cts .tsx", "Java": ".java", "C": ".c .h", "C++": ".cpp .cc .cxx .hpp .hh .hxx", "Go": ".go", "Rust": ".rs",
    "HTML": ".html .htm", "CSS": ".css .scss .sass .less", "JSON": ".json", "YAML": ".yaml .yml", "Markdown": ".md .markdown", "Shell": ".sh .bash", "SQL": ".sql", "Ruby": ".rb", "PHP": ".php", "Kotlin": ".kt", "Swift": ".swift",
}
LANGUAGE_NAMES = {"dockerfile": "Dockerfile", "makefile": "Makefile", "gemfile": "Ruby", "cmakelists.txt": "CMake"}
#: Bytes up to which lines are counted; files per analysis; bytes per repository.
LINE_COUNT_BYTES, MAX_FILES, MAX_REPOSITORY_BYTES = 10 * 1024 * 1024, 10_000, 500 * 1024 * 1024


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def filename_of(path: Column) -> Column:
    return F.element_at(F.split(clean_path(path), "/"), -1)


def suffix_of(path: Column) -> Column:
    """The last suffix with its dot, lower case; empty for none and for names that only start with a dot."""
    return F.lower(F.regexp_extract(filename_of(path), r"^.+(\.[^.]*)$", 1))


def language_of(path: Column) -> Column:
    by_suffix = {s: language for language, suffixes in LANGUAGE_SUFFIXES.items() for s in suffixes.split()}
    return F.coalesce(F.try_element_at(_map(LANGUAGE_NAMES), F.lower(filename_of(path))), F.try_element_at(_map(by_suffix), suffix_of(path)))


def newline_count(text: Column) -> Column:
    """Number of line feeds; a partial last line counts nothing."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def is_scanned(path: Column) -> Column:
    """Whether a scan visits this path: no ignored folder on the way, no ignored suffix."""
    folders = F.slice(F.split(clean_path(path), "/"), 1, F.size(F.split(clean_path(path), "/")) - 1)
    ignored = F.exists(folders, lambda d: F.lower(d).isin(IGNORED_FOLDERS) | d.startswith(".git"))
    return ~ignored & ~suffix_of(path).isin(IGNORED_SUFFIXES)


def discover(files: DataFrame, path: str = "path", content: str = "content", size: str = "size_bytes") -> DataFrame:
    """Scanned files with filename, extension, language, is_analyzable and line_count; other columns stay."""
    language = language_of(F.col(path))
    return files.filter(is_scanned(F.col(path))).withColumns(
        {
            path: clean_path(F.col(path)),
            "filename": filename_of(F.col(path)),
            "extension": suffix_of(F.col(path)),
            "language": language,
            "is_analyzable": language.isNotNull() & (language != "Markdown"),
            "line_count": F.when(F.col(size) <= LINE_COUNT_BYTES, newline_count(F.col(content))),
        }
    )


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Files below ``folder``: path (relative), size_bytes, content. Bytes that are no UTF-8 become U+FFFD."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = folder.removeprefix("file://").rstrip("/") + "/"
    relative = F.element_at(F.split(F.col("path"), root, 2), 2)
    return raw.select(relative.alias("path"), F.col("length").alias("size_bytes"), F.expr("make_valid_utf8(cast(content as string))").alias("content"))


def over_limits(files: DataFrame, group: str, size: str = "size_bytes") -> DataFrame:
    """Groups beyond the limits on files or bytes."""
    sums = files.groupBy(group).agg(F.count("*").alias("files"), F.sum(size).alias("bytes"))
    return sums.filter((F.col("files") > MAX_FILES) | (F.col("bytes") > MAX_REPOSITORY_BYTES))


def language_shares(files: DataFrame, group: str) -> DataFrame:
    """Share of lines per language over analyzable files, in percent with one decimal; of files where no lines are known."""
    per = files.filter("is_analyzable").groupBy(group, "language").agg(F.sum(F.coalesce("line_count", F.lit(0))).cast("long").alias("lines"), F.count("*").alias("files"))
    whole = per.groupBy(group).agg(F.sum("lines").alias("all_lines"), F.sum("files").alias("all_files"))
    share = F.when(F.col("all_lines") > 0, F.col("lines") / F.col("all_lines")).otherwise(F.col("files") / F.col("all_files"))
    return per.join(whole, group).select(group, "language", "lines", "files", F.round(share * 100, 1).alias("share")).filter("lines > 0 or all_lines = 0")


ALLOWED_HOSTS = ("github.com", "www.github.com", "gitlab.com", "www.gitlab.com")


def validate_urls(rows: DataFrame, url: str, hosts: tuple[str, ...] = ALLOWED_HOSTS) -> DataFrame:
    """``rows`` with error (null for a good address), host, owner, name and normalized_url."""
    u = F.trim(F.col(url))
    scheme = F.lower(F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    authority = F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1))
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1), r"^/+|/+$", "")
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    owner, name = F.get(segments, F.lit(0)), F.regexp_replace(F.get(segments, F.lit(1)), r"\.git$", "")
    octet = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
    literal = host.rlike(rf"^(?:{octet}\.){{3}}{octet}$") | host.contains(":") | host.isin("localhost", "localhost.localdomain")
    error = (
        F.when(u.isNull() | (u == ""), "empty")
        .when(u.rlike("[\\x00\\n\\r;&|`$<> ]"), "forbidden character")
        .when(scheme != "https", "not https")
        .when(authority.contains("@"), "credentials")
        .when((port != "") & (port != "443"), "port")
        .when(host == "", "no host")
        .when(literal, "address literal")
        .when(path.contains("..") | path.contains("\\"), "path traversal")
        .when(F.size(segments) != 2, "not owner/name")
        .when(~owner.rlike(r"^[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,37}[a-zA-Z0-9])?$"), "owner")
        .when(~name.rlike(r"^[a-zA-Z0-9_.-]{1,100}$") | name.isin(".", ".."), "name")
        .when(~host.isin(list(hosts)), "host not allowed")
    )
    home = F.when(host.contains("gitlab"), "gitlab.com").otherwise("github.com")
    out = rows.withColumns({"error": error})
    good = F.col("error").isNull()
    return out.withColumns({"host": F.when(good, home), "owner": F.when(good, owner), "name": F.when(good, name), "normalized_url": F.when(good, F.concat_ws("/", F.concat(F.lit("https://"), home), owner, name))})
