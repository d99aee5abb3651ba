"""Programming languages whose lines count."""

from pyspark.sql import Column

# Language names as the line counter prints them.
PROGRAMMING_LANGUAGES = (
    "C",
    "C#",
    "C++",
    "Go",
    "Java",
    "JavaScript",
    "Kotlin",
    "PHP",
    "Python",
    "R",
    "Ruby",
    "Rust",
    "Swift",
    "TypeScript",
)


def is_programming_language(name: Column) -> Column:
    return name.isin(*PROGRAMMING_LANGUAGES)
