"""All registered queries over the driver's tables."""

from photoflow.plans import q_files, q_images, q_json, q_keywords, q_reports, q_store, q_streams  # noqa: F401
from photoflow.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
