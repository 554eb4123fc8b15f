"""Languages by file name; case counts."""

from __future__ import annotations

NAMES = {"Cargo.toml": "TOML", "pyproject.toml": "TOML", "package.json": "JSON", "tsconfig.json": "JSON", "CMakeLists.txt": "CMake", "build.gradle": "Gradle", "settings.gradle": "Gradle", "build.gradle.kts": "Gradle", "Gemfile": "Ruby", "Rakefile": "Ruby"}
#: Files that are no source, whatever their ending.
NONE = {"Dockerfile", "Makefile", "Justfile"}
ENDINGS = {
    "rs": "Rust", "py": "Python", "pyi": "Python", "ts": "TypeScript", "tsx": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript",
    "go": "Go", "java": "Java", "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "hh": "C++", "sh": "Shell", "bash": "Shell", "zsh": "Shell", "toml": "TOML",
    "yaml": "YAML", "yml": "YAML", "json": "JSON", "sql": "SQL", "md": "Markdown", "markdown": "Markdown", "proto": "Protobuf", "graphql": "GraphQL", "gql": "GraphQL", "rb": "Ruby",
    "kt": "Kotlin", "kts": "Kotlin", "swift": "Swift", "cs": "C#", "m": "Objective-C", "mm": "Objective-C", "xml": "XML", "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "CSS",
    "gradle": "Gradle", "cmake": "CMake", "properties": "Properties",
}


def detect(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    if name in NONE:
        return None
    return NAMES.get(name) or (ENDINGS.get(name.rsplit(".", 1)[1]) if "." in name.lstrip(".") else None)


_ALIASES = {
    "rs": "Rust", "rust": "Rust", "py": "Python", "python": "Python", "ts": "TypeScript", "tsx": "TypeScript", "typescript": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "javascript": "JavaScript",
    "go": "Go", "golang": "Go", "java": "Java", "c": "C", "cpp": "C++", "c++": "C++", "cxx": "C++", "cc": "C++", "sh": "Shell", "bash": "Shell", "zsh": "Shell", "shell": "Shell", "toml": "TOML", "yaml": "YAML", "yml": "YAML",
    "json": "JSON", "sql": "SQL", "md": "Markdown", "markdown": "Markdown", "proto": "Protobuf", "protobuf": "Protobuf", "graphql": "GraphQL", "gql": "GraphQL", "rb": "Ruby", "ruby": "Ruby", "kt": "Kotlin", "kotlin": "Kotlin",
    "swift": "Swift", "cs": "C#", "csharp": "C#", "c#": "C#", "objc": "Objective-C", "objective-c": "Objective-C", "objectivec": "Objective-C", "xml": "XML", "html": "HTML", "htm": "HTML", "css": "CSS", "scss": "CSS", "gradle": "Gradle",
    "cmake": "CMake", "properties": "Properties",
}


def from_name(name: str) -> str | None:
    """A language by any of its names, whatever the case; unknown: none."""
    return _ALIASES.get(name.strip().lower())


def chosen(names: list[str]) -> set[str]:
    """The languages of a list of names; unknown ones are passed over, so a list of them alone chooses nothing."""
    return {x for n in names if (x := from_name(n))}
