"""The core's queries. Importing the modules fills registry.CORE."""

from weftline.plans import aggregates, evaluation, exchange, files, gates, joins, landmarks, recovery, sampling, scoring, sequences, sheets, spans, streams, texts  # noqa: F401
from weftline.plans.registry import CORE, Registry  # noqa: F401
