"""Column functions for paths, signatures and source text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a scan takes and leaves out.
SOURCE_EXTENSIONS = [".ts", ".tsx", ".mts", ".cts"]
STRIPPED_EXTENSIONS = [".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs"]
SKIPPED_DIRECTORIES = ["node_modules", ".git", "dist", "build", "out", "coverage", ".next", ".turbo", ".cache", "vendor"]
TEST_DIRECTORIES = ["__tests__", "__test__", "test", "tests", "spec", "__mocks__"]
TYPE_LENGTH, CODE_LENGTH = 400, 20_000


def posix(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def directories(path: Column) -> Column:
    """The directory names of a path, without the file's."""
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def extension(path: Column) -> Column:
    return F.regexp_extract(basename(path), r".(\.[^.]+)$", 1)


def strip_extension(path: Column) -> Column:
    """Without ``.d.ts``, then without one of the known extensions."""
    known = "|".join(x[1:] for x in STRIPPED_EXTENSIONS)
    return F.regexp_replace(F.regexp_replace(path, r"\.d\.ts$", ""), rf"\.(?:{known})$", "")


def relative(path: Column, root: Column | str) -> Column:
    """``path`` below ``root``; outside it, one ``..`` for every further level of ``root``."""
    up = F.lit(root) if isinstance(root, str) else root
    a, b = F.split(F.rtrim(posix(up), F.lit("/")), "/"), F.split(posix(path), "/")
    differs = F.array_position(F.transform(F.sequence(F.lit(0), F.greatest(F.size(a), F.size(b))), lambda i: F.coalesce(F.get(a, i) == F.get(b, i), F.lit(False))), F.lit(False))
    same = differs.cast("int") - 1
    return F.concat_ws("/", F.array_repeat(F.lit(".."), F.size(a) - same), F.slice(b, same + 1, F.size(b)))


def dotted(*parts: Column) -> Column:
    return F.concat_ws(".", *parts)


def constructor_of(signature: Column) -> Column:
    return F.concat(signature, F.lit(".constructor"))


def owner_of(signature: Column) -> Column:
    """What stands before the last dot."""
    return F.when(F.contains(signature, F.lit(".")), F.regexp_extract(signature, r"^(.*)\.[^.]*$", 1)).otherwise(F.lit(""))


def member_of(signature: Column) -> Column:
    return F.substring_index(signature, ".", -1)


def without_constructor(signature: Column) -> Column:
    return F.regexp_replace(signature, r"\.constructor$", "")


def clamp(text: Column, length: int) -> Column:
    return F.substring(text, 1, length)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def is_external(specifier: Column) -> Column:
    """Whether an import names a package: not empty, and neither relative nor absolute."""
    return F.coalesce((specifier != "") & ~specifier.rlike("^[./]"), F.lit(False))


def package_of(path: Column) -> Column:
    """struct(package, path) behind the last ``node_modules/``; null if there is none or a scope lacks its name."""
    tail = F.when(F.contains(path, F.lit("node_modules/")), F.regexp_extract(path, r".*node_modules/(.*)$", 1))
    name = F.regexp_extract(tail, r"^(@[^/]+/[^/]+|[^@/][^/]*)", 1)
    return F.when(name != "", F.struct(name.alias("package"), F.ltrim(F.substring(tail, F.length(name) + 1, F.length(tail)), F.lit("/")).alias("path")))


def location(text: Column) -> Column:
    """``file:line:column:line:column`` as a struct of integers."""
    parts = F.split(text, ":")
    at = lambda k: F.get(parts, k).try_cast("int")
    return F.struct(at(0).alias("file"), at(1).alias("start_line"), at(2).alias("start_column"), at(3).alias("end_line"), at(4).alias("end_column"))


def anonymous_signature(host: Column, line: Column, column: Column) -> Column:
    return F.format_string("%s:<%d:%d>", host, line, column)


def is_docstring(comment: Column) -> Column:
    return comment.startswith("/**")


def declaration_kind(text: Column) -> Column:
    """const, let, var or using by the words a declaration list starts with; unknown for others."""
    word = F.regexp_extract(F.trim(text), r"^(const|let|var|using)\b", 1)
    return F.when(word != "", word).otherwise(F.lit("unknown"))


def is_vendored(path: Column, more: list[str] | None = None) -> Column:
    """Below one of the skipped directories, or one of ``more``."""
    return F.arrays_overlap(directories(path), F.array(*[F.lit(d) for d in [*SKIPPED_DIRECTORIES, *(more or [])]]))


def is_test(path: Column) -> Column:
    """Judged by the path below the root."""
    return F.arrays_overlap(directories(path), F.array(*[F.lit(d) for d in TEST_DIRECTORIES])) | basename(path).isin(TEST_DIRECTORIES) | basename(path).rlike(r"\.(test|spec)\.(ts|tsx|mts|cts)$")


def is_source(path: Column) -> Column:
    return extension(path).isin(SOURCE_EXTENSIONS)
