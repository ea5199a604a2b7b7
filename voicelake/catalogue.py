"""All queries over the given tables, with their SQL twins."""

from voicelake.plans import audio, bench, live, messages, segments, telemetry, transcripts  # noqa: F401
from voicelake.plans.registry import QUERIES, SQL  # noqa: F401
