"""Named queries. Importing the package registers all of them; those of files use the SQL of others."""

from . import citations, cohorts, estimates, files, harvest, identifiers, texts  # noqa: F401
