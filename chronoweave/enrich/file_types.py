"""File types by base name and longest suffix."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The common rule set, as "signature = type"; ``*.x`` is a suffix, anything else a base name.
COMMON = """
*.ts = TypeScript
*.tsx = TSX
*.d.ts = TypeScript
*.js = JavaScript
*.jsx = JSX
*.mjs = JavaScript
*.cjs = JavaScript
*.java = Java
*.aj = AspectJ
*.kt = Kotlin
*.kts = Kotlin Script
*.gradle = Gradle script
*.gradle.kts = Gradle script
*.groovy = Groovy
*.gvy = Groovy
*.gy = Groovy
*.gsh = Groovy Shell
*.go = Go
*.rs = Rust
*.py = Python
*.rb = Ruby
*.php = PHP
*.cs = C#
*.c = C
*.cpp = C++
*.cxx = C++
*.cc = C++
*.hpp = C++ header
*.hh = C++ header
*.swift = Swift
*.scala = Scala
*.dart = Dart
*.lua = Lua
*.r = R
*.sql = SQL
*.sh = Shell
*.bash = Bash
*.zsh = Zsh
*.fish = Fish
*.ps1 = PowerShell
*.html = HTML
*.htm = HTML
*.css = CSS
*.scss = SCSS
*.sass = Sass
*.less = Less
*.vue = Vue
*.svelte = Svelte
*.astro = Astro
*.jsp = JSP
*.jspx = JSPX
*.jspf = JSP fragment
*.tagx = JSP tag file
*.txt = Text
*.json = JSON
*.jsonc = JSONC
*.yaml = YAML
*.yml = YAML
*.toml = TOML
*.xml = XML
*.ini = INI
*.env = dotenv
*.csv = CSV
*.tsv = TSV
*.md = Markdown
*.mdx = MDX
*.rst = reStructuredText
*.adoc = AsciiDoc
*.puml = PlantUML
*.graphql = GraphQL
*.gql = GraphQL
*.proto = Protocol Buffers
*.ipynb = Jupyter Notebook
*.properties = Java properties
*.hocon = HOCON
*.tld = JSP tag library descriptor
*.xjb = JAXB binding
*.jj = JavaCC grammar
*.jjt = JavaCC tree grammar
*.aidl = Android Interface Definition Language
*.svg = SVG
*.png = PNG
*.jpg = JPEG
*.jpeg = JPEG
*.gif = GIF
*.webp = WebP
*.avif = AVIF
*.ico = ICO
*.pdf = PDF
*.lock = lockfile
*.class = Java class file
*.jar = Java archive
*.war = Java web archive
*.ear = Java enterprise archive
*.aar = Android archive
*.jks = Java KeyStore
*.zip = ZIP archive
*.tar = tar archive
*.gz = gzip compressed file
*.tgz = gzip tarball
*.bz2 = bzip2 compressed file
*.xz = XZ compressed file
Dockerfile = Dockerfile
Containerfile = Containerfile
Makefile = Makefile
CMakeLists.txt = CMake project file
package.json = npm package manifest
package-lock.json = npm package lockfile
pnpm-lock.yaml = pnpm lockfile
yarn.lock = Yarn lockfile
tsconfig.json = TypeScript config
jsconfig.json = JavaScript config
Cargo.toml = Cargo manifest
Cargo.lock = Cargo lockfile
pom.xml = Maven POM
mvnw = Maven Wrapper script
mvnw.cmd = Maven Wrapper script
go.mod = Go module file
go.sum = Go checksum file
pyproject.toml = Python project file
requirements.txt = Python requirements file
Pipfile = Pipenv manifest
Pipfile.lock = Pipenv lockfile
Gemfile = Ruby Gemfile
Gemfile.lock = Ruby Gemfile lockfile
composer.json = Composer manifest
composer.lock = Composer lockfile
.gitignore = Git ignore file
.gitattributes = Git attributes file
.gitmodules = Git submodules file
.editorconfig = EditorConfig
.npmrc = npm config
"""
UNKNOWN = "Unknown"


def parse_rules(lines: str) -> list[tuple[str, str]]:
    return [tuple(line.split(" = ", 1)) for line in lines.strip().splitlines()]


def check_rules(rules: list[tuple[str, str]]) -> tuple[dict[str, str], dict[str, str]]:
    """(base names, suffixes in lower case) of rules; raises ValueError for an empty, starred or repeated signature."""
    bases: dict[str, str] = {}
    suffixes: dict[str, str] = {}
    for signature, name in rules:
        if not name:
            raise ValueError(f"no type for {signature!r}")
        suffix = signature.startswith("*.")
        key = signature[1:].lower() if suffix else signature
        if not key or key == "." or "*" in key:
            raise ValueError(f"invalid signature {signature!r}")
        if key in (table := suffixes if suffix else bases):
            raise ValueError(f"repeated signature {signature!r}")
        table[key] = name
    return bases, suffixes


def _literal_map(entries: dict[str, str]) -> Column:
    if not entries:
        return F.create_map().cast(T.MapType(T.StringType(), T.StringType()))
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])


def _suffix_hits(path: Column, suffixes: dict[str, str]) -> list[Column]:
    """Type of the longest suffix of the path that is in the table: the suffixes that can match start at a dot.

    A path's candidates are its ends from each dot on, longest first, looked up in a literal map; no join is needed.
    """
    table = _literal_map(suffixes)
    lower = F.lower(path)
    parts = F.split(lower, r"\.", -1)
    ends = F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.concat(F.lit("."), F.array_join(F.slice(parts, i, F.size(parts)), ".")))
    ends = F.when(F.size(parts) > 1, ends)
    hit = F.filter(ends, lambda e: F.element_at(table, e).isNotNull())
    first = F.get(hit, F.lit(0))
    return [F.element_at(table, first), first]


def classify(path: Column, user_rules: list[tuple[str, str]] | None = None, common: bool = True, unknown: bool = True) -> Column:
    """struct<name, source, matched> of a path, or null if nothing matches and ``unknown`` is off.

    The user's base names come first, then the user's longest suffix, then the same of the common set. Backslashes are
    separators; base names are compared with case, suffixes without.
    """
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    base = F.element_at(F.split(path, "/"), -1)
    found = []
    for source, rules in (("user", user_rules or []), ("common", parse_rules(COMMON) if common else [])):
        if not rules:
            continue
        bases, suffixes = check_rules(rules)
        by_base = F.element_at(_literal_map(bases), base)
        found.append(F.when(by_base.isNotNull(), F.struct(by_base.alias("name"), F.lit(source).alias("source"), base.alias("matched"))))
        name, end = _suffix_hits(path, suffixes)
        found.append(F.when(name.isNotNull(), F.struct(name.alias("name"), F.lit(source).alias("source"), F.concat(F.lit("*"), end).alias("matched"))))
    if unknown:
        none = F.lit(None).cast("string")
        found.append(F.when(path.isNotNull(), F.struct(F.lit(UNKNOWN).alias("name"), none.alias("source"), none.alias("matched"))))
    return F.coalesce(*found)
