"""The subpackage's own registry of queries."""

from weftline.plans.registry import Registry

LLM = Registry()
