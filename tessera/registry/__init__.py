"""Query registry: ``QUERIES[name](spark, sf_dir) -> DataFrame`` and the matching
DuckDB SQL in ``ORACLE[name]`` (absent for operators that SQL cannot express)."""

from tessera.registry.base import ORACLE, QUERIES  # noqa: F401
from tessera.registry import cleaning  # noqa: F401,E402
from tessera.registry import repair  # noqa: F401,E402
from tessera.registry import descriptive  # noqa: F401,E402
from tessera.registry import stats  # noqa: F401,E402
from tessera.registry import discriminant  # noqa: F401,E402
from tessera.registry import multivariate  # noqa: F401,E402
