"""The subpackage's queries; importing this module fills LLM."""

from weftline.llm import plans_match, plans_text  # noqa: F401
from weftline.llm.registry import LLM  # noqa: F401
