"""The inclusion policy for files, and what counts as built or third-party code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftmill.config import DEFAULT, EngineConfig
from siftmill.functions.text import any_of, extension, file_name, holds

# Fixed values of the policy.
EXCLUDED_DIRS = ("node_modules", "vendor", "dist", "build", "coverage", ".git", "__pycache__", "libs", "cdn")
MINIFIED_PARTS = (".min.js", ".bundle.js", ".chunk.js", "bundle.js")
APPLICATION_NAMES = ("application.js", "common.js", "main.js")
LIBRARY_NAME = r"^(?:jquery-ui\.js|jquery\.fullpage\.js|jquery\.selectbox\.js|jquery\.[^.]+\.js|(?:bootstrap|lodash|underscore|moment|slick|swiper|chart|d3)\.js)$"
LIBRARY_DIR = r"/(?:vendor|vendors|node_modules|lib|libs|plugins)/"
HASHED_NAME = r"^(?:(?:main|runtime-main|vendor|vendors|chunk-vendors)\.[a-f0-9]{6,}|(?:app|commons|framework|webpack-runtime|runtime|polyfill|polyfills|vendors?|component---.+)-[a-f0-9]{8,}|[0-9]+-[a-f0-9]{8,}|[a-f0-9]{8,}-[a-f0-9]{8,}|.+-[a-f0-9]{12,})\.js$"
BUILT_NAME = r"^(?:(?:app|commons|framework|webpack-runtime|runtime|polyfill|polyfills|vendors?|component---.+)-[a-f0-9]{8,}|[0-9]+-[a-f0-9]{8,}|[a-f0-9]{8,}-[a-f0-9]{8,}|.+-[a-f0-9]{12,})\.js$"
SIGNATURES = ("webpackChunk", "webpackJsonp", "__webpack_require__", "/*! For license information please see", ".LICENSE.txt", "sourceMappingURL=", "self.webpackChunk")
BUILT_SIGNATURES = ("webpackchunk", "__webpack_require__", ".license.txt", "sourcemappingurl")
CONFIG_NAMES = ("package.json", "dockerfile", "docker-compose.yml", "docker-compose.yaml", "config.js", "config.json", "app.config.js", "vite.config.js", "webpack.config.js", "next.config.js", "nuxt.config.js")
SOURCE_EXTENSIONS = (".js", ".ts", ".jsx", ".tsx", ".vue", ".mjs", ".cjs")
TEMPLATE_EXTENSIONS = (".html", ".htm", ".ejs", ".hbs", ".pug", ".jsp", ".do", ".php", ".asp", ".aspx")
JQUERY_NAMES = ("jquery-ui.js", "jquery.fullpage.js", "jquery.selectbox.js")

REASONS = {
    "EXCLUDED_DIR": "below a folder that is never analysed",
    "EXCLUDED_TOO_LARGE": "larger than the limit for a file",
    "EXCLUDED_BINARY": "binary",
    "EXCLUDED_MINIFIED": "minified or generated",
    "EXCLUDED_THIRD_PARTY_LIBRARY": "a third-party library",
    "EXCLUDED_EXTENSION": "not a kind of file that is analysed",
    "INCLUDED_CONFIG": "configuration",
    "INCLUDED_SOURCE": "source",
    "INCLUDED_TEMPLATE": "template",
}


def reason_code(path: Column, size: Column, raw: Column, config: EngineConfig = DEFAULT) -> Column:
    """First rule that holds, cheap ones first; ``raw`` are the file's bytes, of which only the first 8192 count."""
    low = F.lower(path)
    name, rooted, kind = file_name(low), F.concat(F.lit("/"), low), extension(path)
    head = F.substring(raw, 1, 8192)
    guarded = name.endswith(".js") & ~name.isin(*APPLICATION_NAMES)
    signed = F.lit(False)
    for s in SIGNATURES:
        signed = signed | F.contains(head, F.lit(s.encode()))
    return (
        F.when(F.arrays_overlap(F.split(low, "/"), F.array(*map(F.lit, EXCLUDED_DIRS))), "EXCLUDED_DIR")
        .when(size > config.max_file_bytes, "EXCLUDED_TOO_LARGE")
        .when(F.contains(F.substring(raw, 1, 4096), F.lit(b"\0")), "EXCLUDED_BINARY")
        .when(any_of(name, MINIFIED_PARTS), "EXCLUDED_MINIFIED")
        .when(guarded & (name.rlike(LIBRARY_NAME) | rooted.rlike(LIBRARY_DIR)), "EXCLUDED_THIRD_PARTY_LIBRARY")
        .when(guarded & (name.rlike(HASHED_NAME) | signed), "EXCLUDED_MINIFIED")
        .when((F.contains(rooted, F.lit("/static/js/")) & F.contains(low, F.lit(".js"))) | name.endswith(".license.txt") | name.endswith(".map"), "EXCLUDED_MINIFIED")
        .when(name.isin(".env.example", ".env.sample"), "INCLUDED_CONFIG")
        .when(name.endswith(".env"), "EXCLUDED_EXTENSION")
        .when(name.isin(*CONFIG_NAMES) | (kind == ".json"), "INCLUDED_CONFIG")
        .when(kind.isin(*SOURCE_EXTENSIONS), "INCLUDED_SOURCE")
        .when(kind.isin(*TEMPLATE_EXTENSIONS), "INCLUDED_TEMPLATE")
        .otherwise("EXCLUDED_EXTENSION")
    )


def inventory(files: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Files (path, raw, further columns) with extension, size, include, reason, reason_code and priority."""
    out = files.withColumn("size", F.octet_length("raw").cast("long"))
    out = out.withColumns({"extension": extension(F.col("path")), "reason_code": reason_code(F.col("path"), F.col("size"), F.col("raw"), config)})
    reasons = F.create_map(*[F.lit(x) for pair in REASONS.items() for x in pair])
    priority = F.when(F.col("reason_code") == "INCLUDED_SOURCE", 1).when(F.col("reason_code") == "INCLUDED_CONFIG", 2).when(F.col("reason_code") == "INCLUDED_TEMPLATE", 3).otherwise(100)
    return out.withColumns({"include": F.col("reason_code").startswith("INCLUDED"), "reason": reasons[F.col("reason_code")], "priority": priority})


def inventory_counts(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("total_files_scanned"), F.count_if("include").alias("included_count"), F.count_if(~F.col("include")).alias("excluded_count"))


def _built(path: Column, content: Column, directories: str, names: tuple[str, ...] = (), low_content: Column | None = None) -> Column:
    low = F.lower(path)
    name = file_name(low)
    signed = any_of(F.lower(F.substring(content, 1, 8192)), BUILT_SIGNATURES)
    if low_content is not None:
        signed = holds(low_content, BUILT_SIGNATURES) & signed
    return name.isin(*names) | (holds(name, ("-",)) & name.rlike(BUILT_NAME)) | low.rlike(directories) | signed


def built_for_chunks(path: Column, content: Column) -> Column:
    """Build output or third-party code, as the chunk rules see it: paths are relative, so a folder lib at the root does not count."""
    return _built(path, content, r"/(?:vendor|vendors|node_modules|lib|plugins)/", ("",))


def built_for_files(path: Column, content: Column, low_content: Column | None = None) -> Column:
    """The same as the file rules see it: folders libs and three more names count too.  The content in lower case, where it is at hand, saves a search."""
    return _built(path, content, LIBRARY_DIR, JQUERY_NAMES, low_content)


def load(files: DataFrame, contents: DataFrame, config: EngineConfig = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Route inventory rows to loaded (with content and its hash) or skipped (with a code), by the first cause that holds.

    ``contents`` has path and raw, and may have kind: file, or other for what is no plain file.  A path that it lacks was not
    found; a file without raw could not be read.  An inventory that is its own ``contents`` has its bytes in its rows: nothing is joined."""
    kind = F.col("kind") if "kind" in contents.columns else F.when(F.col("raw").isNotNull(), "file")
    if contents is files:
        joined = files.withColumns({"bytes": F.col("raw"), "kind": kind}).drop("raw")
    else:
        joined = files.drop("raw").join(contents.select("path", F.col("raw").alias("bytes"), kind.alias("kind")), "path", "left")
    text = F.col("bytes").cast("string")
    code = (
        F.when(~F.col("include"), "SKIPPED_NOT_INCLUDED")
        .when(F.col("path").startswith("/") | F.array_contains(F.split("path", "/"), ".."), "SKIPPED_PATH_TRAVERSAL")
        .when(F.col("kind").isNull() & F.col("bytes").isNull(), "SKIPPED_NOT_FOUND")
        .when(F.col("kind") == "other", "SKIPPED_NOT_FILE")
        .when(F.octet_length("bytes") > config.max_file_bytes, "SKIPPED_TOO_LARGE")
        .when(F.col("bytes").isNull(), "SKIPPED_READ_ERROR")
        .when(~F.is_valid_utf8(text), "SKIPPED_DECODE_ERROR")
    )
    joined = joined.withColumn("skip_code", code)
    loaded = joined.where("skip_code is null").withColumns({"content": text, "content_hash": F.sha2("bytes", 256)}).drop("bytes", "kind", "skip_code")
    skipped = joined.where("skip_code is not null").withColumns({"include": F.lit(False), "reason_code": F.col("skip_code")}).drop("bytes", "kind", "skip_code")
    return loaded, skipped
