"""Life-cycle-assessment analytics on Spark."""

from . import audits, compiler, library, records, registry, solving, values  # noqa: F401 (the others register their queries)
