"""Programming-language labels: class names, aliases, content detection."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemark.functions.arrays import constant_map, let, reused, strict_json

# ---------------------------------------------------------------- fixed values
# alias -> canonical name
LANGUAGE_ALIASES = {
    "js": "javascript", "jsx": "javascript", "node": "javascript",
    "ts": "typescript", "tsx": "typescript",
    "py": "python", "python3": "python", "python2": "python",
    "sh": "bash", "shell": "bash", "zsh": "bash", "fish": "bash",
    "powershell": "powershell", "ps1": "powershell",
    "yml": "yaml", "md": "markdown", "mdown": "markdown", "htm": "html",
    "c++": "cpp", "cplusplus": "cpp", "c#": "csharp", "cs": "csharp",
    "objc": "objective-c",
    "kt": "kotlin", "groovy": "groovy", "scala": "scala",
    "hs": "haskell", "clj": "clojure", "cljs": "clojure", "erl": "erlang",
    "ex": "elixir", "exs": "elixir", "fs": "fsharp", "fsx": "fsharp",
    "rs": "rust", "golang": "go",
    "rb": "ruby", "pl": "perl", "lua": "lua", "r": "r",
    "swift": "swift", "dart": "dart",
    "json5": "json", "jsonc": "json", "toml": "toml",
    "ini": "ini", "cfg": "ini", "conf": "ini",
    "pgsql": "sql", "mysql": "sql", "plsql": "sql", "tsql": "sql",
    "tex": "latex", "latex": "latex", "rst": "restructuredtext", "adoc": "asciidoc",
    "dockerfile": "dockerfile", "docker": "dockerfile",
    "makefile": "makefile", "make": "makefile",
    "graphql": "graphql", "gql": "graphql", "proto": "protobuf",
    "diff": "diff", "patch": "diff", "regex": "regex", "regexp": "regex",
}
# prefixes of class names that carry a language, in order of precedence
CLASS_PREFIXES = ("lang-", "language-", "s-lang-", "hljs-", "prism-", "code-", "syntax-")
# content rules in order of precedence: (language, any of these ..., and any of these)
DETECTION_RULES = (
    ("html", [r"(?i)<!DOCTYPE html>|<html|<div|<head|<body|<script|<style"]),
    ("xml", [r"<\?xml|<AppDomains?>"]),
    ("rust", [r"\bfn\s+\w+\s*\("], [r"\blet\s+mut\s+", r"use\s+std::", r"println!"]),
    ("javascript", [
        r"\b(const|let|var)\s+\w+", r"\bfunction\s+\w+\s*\(", r"=>",
        r"console\.(log|error|warn)", r"async\s+function", r"await\s+", r"\.then\(",
        r"Office\.(context|onReady)", r"asyncResult", r"getElementById|querySelector",
    ]),
    ("typescript", [r":\s*(string|number|boolean|void|any)\b", r"\binterface\s+\w+"]),
    ("python", [
        r"\b(import|from)\s+\w+", r"\bdef\s+\w+\s*\(", r"\bclass\s+\w+", r"\bprint\s*\(",
        r"if\s+__name__\s*==", r"(?m):\s*$",
    ]),
    ("bash", [
        r"(?m)^\$\s", r"(?m)^#!\s*/bin/(bash|sh)",
        r"\b(sudo|apt-get|brew|npm|pip|git|docker|cd|ls|mkdir)\s", r"\bexport\s+\w+=",
    ]),
    ("json", [r"\A\s*[\{\[]"], [r""":\s*[\{\[\"\'\d]"""]),
    ("css", [r"\w+\s*\{[^}]*\}"], [r"(color|width|height|margin|padding):"]),
    ("sql", [r"(?i)\b(SELECT|INSERT|UPDATE|DELETE|CREATE|DROP|ALTER|FROM|WHERE|JOIN)\b"]),
    ("yaml", [r"(?m)^\w+:\s*$", r"(?m)^\s+-\s+\w+"]),
    ("go", [r"\bpackage\s+\w+", r"\bfunc\s+\w+\s*\("]),
    ("rust", [r"\bfn\s+\w+", r"\blet\s+mut\s+", r"use\s+std::"]),
    ("java", [r"\b(public|private|protected)\s+(class|interface)", r"System\.out\.println"]),
    ("cpp", [r"#include\s*<", r"\bstd::", r"int\s+main\s*\("],
     [r"\bstd::", r"#include\s*<iostream>"]),
    ("c", [r"#include\s*<", r"\bstd::", r"int\s+main\s*\("]),
    ("csharp", [r"\bnamespace\s+\w+", r"\busing\s+System"]),
    ("ruby", [r"\b(def|end|require|puts|attr_accessor)\b"]),
    ("php", [r"<\?php", r"\$\w+\s*="]),
    ("swift", [r"\b(func|var|let)\s+\w+"], [r"->"]),
    ("kotlin", [r"\b(fun|val|var)\s+\w+"]),
    ("markdown", [r"(?m)^#{1,6}\s"], [r"\[[^\n]*?\]\([^\n]*?\)"]),
    ("dockerfile", [r"(?im)^\s*(FROM|RUN|COPY|ADD|WORKDIR|ENV|EXPOSE)\s+"]),
)
# ---------------------------------------------------------------- end of fixed values
#: Strings of which a text must hold one for the rule pattern to be found in it; they are
#: looked for first, as that costs less. Patterns without an entry are tried on every text.
NEEDED = {
    r"(?i)<!DOCTYPE html>|<html|<div|<head|<body|<script|<style": ("<",),
    r"<\?xml|<AppDomains?>": ("<?xml", "<AppDomain"),
    r"\bfn\s+\w+\s*\(": ("fn",), r"\bfn\s+\w+": ("fn",), r"\blet\s+mut\s+": ("mut",),
    r"use\s+std::": ("std::",), r"println!": ("println!",),
    r"\b(const|let|var)\s+\w+": ("const", "let", "var"), r"\bfunction\s+\w+\s*\(": ("function",),
    r"=>": ("=>",), r"console\.(log|error|warn)": ("console.",), r"async\s+function": ("async",),
    r"await\s+": ("await",), r"\.then\(": (".then(",), r"Office\.(context|onReady)": ("Office.",),
    r"asyncResult": ("asyncResult",),
    r"getElementById|querySelector": ("getElementById", "querySelector"),
    r":\s*(string|number|boolean|void|any)\b": (":",), r"\binterface\s+\w+": ("interface",),
    r"\b(import|from)\s+\w+": ("import", "from"), r"\bdef\s+\w+\s*\(": ("def",),
    r"\bclass\s+\w+": ("class",), r"\bprint\s*\(": ("print",), r"if\s+__name__\s*==": ("__name__",),
    r"(?m):\s*$": (":",),
    r"(?m)^\$\s": ("$",), r"(?m)^#!\s*/bin/(bash|sh)": ("#!",), r"\bexport\s+\w+=": ("export",),
    r""":\s*[\{\[\"\'\d]""": (":",),
    r"\w+\s*\{[^}]*\}": ("{",), r"(color|width|height|margin|padding):": (":",),
    r"(?m)^\w+:\s*$": (":",), r"(?m)^\s+-\s+\w+": ("-",),
    r"\bpackage\s+\w+": ("package",), r"\bfunc\s+\w+\s*\(": ("func",),
    r"\b(public|private|protected)\s+(class|interface)": ("public", "private", "protected"),
    r"System\.out\.println": ("System.out.println",),
    r"#include\s*<": ("#include",), r"#include\s*<iostream>": ("#include",), r"\bstd::": ("std::",),
    r"int\s+main\s*\(": ("main",),
    r"\bnamespace\s+\w+": ("namespace",), r"\busing\s+System": ("System",),
    r"\b(def|end|require|puts|attr_accessor)\b": ("def", "end", "require", "puts", "attr_accessor"),
    r"<\?php": ("<?php",), r"\$\w+\s*=": ("$",),
    r"\b(func|var|let)\s+\w+": ("func", "var", "let"), r"->": ("->",),
    r"\b(fun|val|var)\s+\w+": ("fun", "val", "var"),
    r"(?m)^#{1,6}\s": ("#",), r"\[[^\n]*?\]\([^\n]*?\)": ("](",),
}


def lang_alias(spark: SparkSession) -> DataFrame:
    """The alias table as a DataFrame, for joins."""
    return spark.createDataFrame(list(LANGUAGE_ALIASES.items()), "alias string, lang string")


def normalize_language(lang: Column) -> Column:
    aliases = constant_map(LANGUAGE_ALIASES)
    return let(lang, lambda name: F.coalesce(F.element_at(aliases, name), name))


@reused
def lang_from_class(classes: Column) -> Column:
    """Language named by the class attribute of a code element, or ''."""
    def named(text: Column) -> Column:
        return F.coalesce(*(
            F.nullif(F.regexp_extract(text, rf"\b{prefix}(\w+)", 1), F.lit(""))
            for prefix in CLASS_PREFIXES
        ))

    return F.coalesce(normalize_language(F.lower(let(classes, named))), F.lit(""))


def _java_flags(pattern: str) -> str:
    # only "\n" ends a line
    return pattern.replace("(?m)", "(?md)").replace("(?im)", "(?imd)")


@reused
def detect_code_language(code: Column) -> Column:
    """Language guessed from the code itself, or ''."""
    def holds(text: Column, pattern: str) -> Column | None:
        found = None
        for needed in NEEDED.get(pattern, ()):
            one = F.contains(text, F.lit(needed))
            found = one if found is None else found | one
        return found

    def any_of(text: Column, patterns: list[str]) -> Column:
        hit = None
        for pattern in patterns:
            one, possible = text.rlike(_java_flags(pattern)), holds(text, pattern)
            one = one if possible is None else possible & one
            hit = one if hit is None else hit | one
        return hit

    def possible_in(text: Column, groups: tuple[list[str], ...]) -> Column | None:
        """That a rule of several groups can hold, before the first regex of any is tried."""
        all_ = None
        for group in groups:
            each = [holds(text, pattern) for pattern in group]
            if len(groups) > 1 and all(e is not None for e in each):
                one = functools.reduce(Column.__or__, each)
                all_ = one if all_ is None else all_ & one
        return all_

    def cascade(text: Column) -> Column:
        chain = None
        for lang, *groups in DETECTION_RULES:
            condition = any_of(text, groups[0])
            for group in groups[1:]:
                condition = condition & any_of(text, group)
            if lang == "json":
                condition = condition & strict_json(text).isNotNull()
            possible = possible_in(text, groups)
            condition = condition if possible is None else possible & condition
            chain = F.when(condition, lang) if chain is None else chain.when(condition, lang)
        return chain.otherwise("")

    return let(code, cascade)
