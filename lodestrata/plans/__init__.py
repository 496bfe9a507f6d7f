"""Queries and their SQL."""

from lodestrata.plans import queries as _queries  # noqa: F401, I001
from lodestrata.plans import documents as _documents  # noqa: F401
from lodestrata.plans import tables as _tables  # noqa: F401
from lodestrata.plans import named as _named  # noqa: F401
from lodestrata.plans import talks as _talks  # noqa: F401
from lodestrata.plans import likenesses as _likenesses  # noqa: F401
from lodestrata.plans import sinks as _sinks  # noqa: F401
from lodestrata.plans import audited as _audited  # noqa: F401
from lodestrata.plans import forms as _forms  # noqa: F401
