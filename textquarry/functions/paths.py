"""Paths: scopes, globs, languages, relations."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """``**`` (and ``**/``) stands for anything, ``*`` for anything but a slash, ``?`` for one character but a slash."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**", i):
            i += 3 if glob.startswith("**/", i) else 2
            out.append("[\\s\\S]*")
        else:
            out.append({"*": "[^/]*", "?": "[^/]"}.get(glob[i]) or re.escape(glob[i]))
            i += 1
    return "^" + "".join(out) + "$"


def _entry(path: Column, entry: str) -> Column:
    if any(c in entry for c in "*?"):
        return path.rlike(glob_regex(entry))
    e = entry.strip("/")
    return (path == e) | path.endswith(f"/{e}") | path.startswith(f"{e}/") | F.contains(path, F.lit(f"/{e}/"))


def in_scope(path: Column, scope: list[str]) -> Column:
    """Whether a scope list covers a path; entries with ! exclude, a list of them alone includes all else."""
    yes = [_entry(path, s) for s in scope if not s.startswith("!")]
    no = [_entry(path, s[1:]) for s in scope if s.startswith("!")]
    out = reduce(lambda a, b: a | b, yes) if yes else F.lit(True)
    return reduce(lambda a, b: a & ~b, no, out)


# Languages by path suffix, the first that fits.
LANGUAGES = {
    "rust": (".rs",),
    "python": (".py", ".pyi", ".pyw"),
    "tsx": (".tsx",),
    "typescript": (".ts", ".mts", ".cts"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "go": (".go",),
    "dart": (".dart",),
    "java": (".java",),
    "ruby": (".rb",),
    "swift": (".swift",),
    "kotlin": (".kt", ".kts"),
    "c": (".c",),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".h", ".hh", ".hxx"),
    "csharp": (".cs",),
    "php": (".php",),
}
# What a language filter covers.
FILTERS = {
    "rust": (".rs",),
    "python": (".py", ".pyi", ".pyw"),
    "js": (".js", ".jsx", ".mjs", ".cjs"),
    "ts": (".ts", ".tsx", ".mts", ".cts"),
    "go": (".go",),
    "dart": (".dart",),
    "java": (".java",),
    "ruby": (".rb",),
    "swift": (".swift",),
    "kotlin": (".kt", ".kts"),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".h", ".hh", ".hxx"),
    "cs": (".cs",),
    "php": (".php",),
    "yaml": (".yaml", ".yml"),
    "json": (".json",),
    "toml": (".toml",),
    "dockerfile": (".dockerfile", "Dockerfile"),
    "md": (".md", ".markdown"),
    "html": (".html", ".htm"),
    "css": (".css",),
    "sh": (".sh", ".bash"),
    "xml": (".xml",),
    "text": (".txt",),
}
# Other names of languages, interpreters of scripts.
ALIASES = {
    "rs": "rust", "py": "python", "javascript": "js", "typescript": "ts", "golang": "go", "rb": "ruby", "kt": "kotlin",
    "c++": "cpp", "csharp": "cs", "yml": "yaml", "docker": "dockerfile", "markdown": "md", "bash": "sh", "shell": "sh", "txt": "text",
}
SHEBANGS = {"python": "python", "node": "javascript", "ruby": "ruby"}


def language(path: Column, text: Column | None = None) -> Column:
    """Language of a file by its suffix, else by the interpreter line of its text, else generic."""
    low = F.lower(path)
    out = None
    for name, suffixes in LANGUAGES.items():
        hit = reduce(lambda a, b: a | b, (low.endswith(s) for s in suffixes))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    if text is None:
        return out.otherwise("generic")
    first = F.lower(F.substring_index(text, "\n", 1))
    for word, name in SHEBANGS.items():
        out = out.when(first.startswith("#!") & F.contains(first, F.lit(word)), name)
    return out.otherwise("generic")


def py_language(path: str, text: str = "") -> str:
    low = path.lower()
    for name, suffixes in LANGUAGES.items():
        if low.endswith(suffixes):
            return name
    first = text.split("\n", 1)[0].lower()
    return next((name for word, name in SHEBANGS.items() if first.startswith("#!") and word in first), "generic")


def lang_suffixes(lang: str) -> list[str]:
    """Suffixes of a comma-separated list of languages; none if all are unknown."""
    out: list[str] = []
    for part in lang.split(","):
        name = part.strip().lower()
        out += [s for s in FILTERS.get(ALIASES.get(name, name), ()) if s not in out]
    return out


def lang_filter(path: Column, lang: str, text: Column | None = None) -> Column:
    suffixes = lang_suffixes(lang)
    out = reduce(lambda a, b: a | b, (path.endswith(s) for s in suffixes), F.lit(False))
    if text is not None:
        names = [ALIASES.get(p.strip().lower(), p.strip().lower()) for p in lang.split(",")]
        wanted = [{"js": "javascript"}.get(n, n) for n in names]
        bare = ~F.contains(F.element_at(F.split(path, "/"), -1), F.lit("."))
        out = out | (bare & language(path, text).isin(wanted))
    return out


def family(lang: Column) -> Column:
    """Languages that a rename may cross."""
    return F.when(lang.isin("javascript", "typescript", "tsx"), "javascript").otherwise(lang)


# Files that tools generate, directories that are no sources, files that mark a package.
GENERATED = (".g.dart", ".freezed.dart", ".pb.go", ".pb.dart", "_pb2.py", "_pb2_grpc.py", ".min.js", ".min.css", ".gen.go", ".generated.go", ".designer.cs")
SKIPPED_DIRS = ("target", "node_modules", ".git", "dist", "build", ".venv", "venv", "vendor", ".next", "__pycache__", ".mypy_cache", ".pytest_cache")
MANIFESTS = ("package.json", "Cargo.toml", "go.mod", "pyproject.toml", "setup.py", "setup.cfg", "build.gradle", "build.gradle.kts", "pom.xml", "pubspec.yaml", "Gemfile")


def is_generated(path: Column) -> Column:
    low = F.lower(path)
    ends = reduce(lambda a, b: a | b, (low.endswith(s) for s in GENERATED))
    return ends | F.contains(low, F.lit(".generated.")) | F.exists(F.split(low, "/"), lambda s: s.isin("generated", "__generated__"))


def in_skipped_dir(path: Column) -> Column:
    dirs = F.split(path, "/")
    return F.exists(F.slice(dirs, 1, F.greatest(F.size(dirs) - 1, F.lit(0))), lambda s: s.isin(*SKIPPED_DIRS) | (s.startswith(".") & (F.length(s) > 1)))


def relative(source: Column, target: Column) -> Column:
    """Path from the directory of one file to another."""
    have, want = F.split(source, "/"), F.split(target, "/")
    most = F.least(F.size(have), F.size(want)) - 1
    equal = F.filter(F.sequence(F.lit(0), most), lambda i: (i > 0) & (F.slice(have, 1, i) == F.slice(want, 1, i)))
    up = F.size(have) - 1 - F.size(equal)
    rest = F.array_join(F.slice(want, F.size(equal) + 1, F.size(want)), "/")
    return F.concat(F.when(up > 0, F.repeat(F.lit("../"), up)).otherwise("./"), rest)


# How a file brings in a symbol, by its suffix; {from} is the relative path of the
# definition, {stem} that without suffix, {dots} and {colons} its path as a module.
IMPORTS = {
    ("ts", "tsx", "js", "jsx", "mjs", "cjs"): "import { {symbol} } from '{stem}';",
    ("dart",): "import '{from}';",
    ("py",): "from {dots} import {symbol}    # best-effort module path — verify",
    ("rs",): "use crate::{colons}::{symbol};    // best-effort module path — verify",
    ("go",): "// `{symbol}` is in {file}; Go imports are package-level — import that package path",
    (): "// `{symbol}` is defined in {file}; add an import in {target}'s style",
}


def import_statement(symbol: Column, target: Column, definition: Column) -> Column:
    """How the target file brings in a symbol defined elsewhere."""
    bare = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    near = relative(target, definition)
    module = bare(F.element_at(F.split(definition, "src/", -1), -1))
    fill = {
        "from": near, "stem": bare(near), "dots": F.replace(bare(definition), F.lit("/"), F.lit(".")),
        "colons": F.replace(module, F.lit("/"), F.lit("::")), "file": definition, "target": target, "symbol": symbol,
    }
    suffix, out = F.element_at(F.split(target, r"\."), -1), F.lit(IMPORTS[()])
    for suffixes, template in IMPORTS.items():
        if suffixes:
            out = F.when(suffix.isin(*suffixes), template).otherwise(out)
    for name, value in fill.items():
        out = F.replace(out, F.lit(f"{{{name}}}"), value)
    return out
