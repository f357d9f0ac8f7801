"""All queries of the library by name, and the SQL of each."""

from __future__ import annotations

from redactory.plans import activity, checks, detection, forms, masking, review, roster, stores, streams
from redactory.plans.detection import flagship  # noqa: F401

QUERIES = {**detection.QUERIES, **roster.QUERIES, **activity.QUERIES, **masking.QUERIES, **streams.QUERIES, **forms.QUERIES, **checks.QUERIES, **review.QUERIES, **stores.QUERIES}
SQL = {**detection.SQL, **roster.SQL, **activity.SQL, **masking.SQL, **streams.SQL, **forms.SQL, **checks.SQL, **review.SQL, **stores.SQL}
