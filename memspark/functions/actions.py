"""Turning a tool action into a search query."""

from pyspark.sql import Column, functions as F

from .text import col


def file_query(tool, path, command) -> Column:
    """Read/Edit: file stem and two parent folders; Write: conventions of the folders; test/build commands: fixed queries."""
    t, p, c = col(tool), col(path), F.coalesce(col(command), F.lit(""))
    parts = F.split(p, "/")
    n = F.size(parts)
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.\w+$", "")
    dirs = F.array_join(F.slice(parts, F.greatest(n - 2, F.lit(1)), F.least(F.lit(2), F.greatest(n - 1, F.lit(0)))), " ")
    read = F.substring(F.trim(F.concat(stem, F.lit(" "), dirs)), 1, 200)
    return (F.when(t.isin("Read", "Edit") & p.isNotNull(), read)
            .when((t == "Write") & p.isNotNull(), F.trim(F.concat(F.lit("conventions "), dirs)))
            .when((t == "Bash") & F.contains(c, F.lit("test")), "test failures known issues")
            .when((t == "Bash") & c.rlike("build|npm run|npx"), "build errors dependencies"))
