"""Identity, naming and header-text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_COLLECTION = "quarry"
PREFIX = "quarry_"
LANGUAGES = {".go": "go", ".py": "python", ".ts": "typescript", ".tsx": "typescript", ".js": "javascript", ".jsx": "javascript"}
MORE_LANGUAGES = LANGUAGES | {".mjs": "javascript", ".cjs": "javascript"}
#: Unicode white space that text trimming removes.
BLANK = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def content_hash(text: Column) -> Column:
    """Lower-case hexadecimal SHA-256."""
    return F.sha2(text, 256)


def point_id(code_hash: Column) -> Column:
    """The first eight bytes of the hash of a hash, as a decimal string."""
    return F.conv(F.substring(F.sha2(code_hash, 256), 1, 16), 16, 10)


def trimmed(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def collection_name(project: Column) -> Column:
    """Prefix and trimmed project id, or the shared name for a blank one."""
    name = trimmed(F.coalesce(project, F.lit("")))
    return F.when(name == "", F.lit(DEFAULT_COLLECTION)).otherwise(F.concat(F.lit(PREFIX), name))


def language_of(path: Column, more: bool = False) -> Column:
    """Language by extension; more: any case, and module extensions too."""
    extension = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    known = MORE_LANGUAGES if more else LANGUAGES
    extension = F.lower(extension) if more else extension
    found = F.lit("")
    for ending, language in known.items():
        found = F.when(extension == ending, F.lit(language)).otherwise(found)
    return found


def line_count(start: Column, end: Column) -> Column:
    return end - start + 1


def stringified(items: Column) -> Column:
    """A list as `[a b c]`."""
    return F.concat(F.lit("["), F.array_join(items, " "), F.lit("]"))


def callees(code: Column, dollar: bool = True) -> Column:
    """Distinct call targets in order of appearance; dollar: as in ECMAScript, which also excludes `switch`."""
    word = r"([A-Za-z_$][A-Za-z0-9_$]*)[ \t\n\f\r]*\(" if dollar else r"([A-Za-z_][A-Za-z0-9_]*)[ \t\n\f\r]*\("
    skip = ["if", "for", "while", "return", *(["switch"] if dollar else [])]
    return F.array_except(F.array_distinct(F.regexp_extract_all(code, F.lit(word), F.lit(1))), F.array(*map(F.lit, skip)))


def embedding_text(row: dict[str, Column]) -> Column:
    """Header lines and code: four lines always, the others where they say something, a blank line, the code."""
    always = ["file_path", "language", "node_name", "node_type"]
    lines = [F.concat(F.lit(f"{c}: "), F.coalesce(row[c], F.lit(""))) for c in always]
    for name, key in (("package", "package_name"), ("imports", "imports"), ("signature", "signature"), ("receiver", "receiver"), ("doc", "doc"), ("callees", "callees"), ("param_types", "param_types"), ("return_types", "return_types")):
        if key not in row:
            continue
        value = row[key]
        if key in ("imports", "callees", "param_types", "return_types"):
            lines.append(F.when(F.size(value) > 0, F.concat(F.lit(f"{name}: "), F.array_join(value, ", "))))
        else:
            lines.append(F.when(value != "", F.concat(F.lit(f"{name}: "), value)))
    if "has_error_return" in row:
        lines.append(F.when(row["has_error_return"], F.lit("has_error_return: true")))
    return F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), F.coalesce(row["content"], F.lit("")))


def payload(stored: Column) -> Column:
    """The fields of a stored JSON object, as text by name; numbers, flags and lists in their JSON form, null if it is none."""
    return F.from_json(stored, "map<string,string>")
