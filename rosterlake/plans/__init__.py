

from . import capture, catalog, pages, register, telling  # noqa: F401  (the latter add their queries to the catalog)
