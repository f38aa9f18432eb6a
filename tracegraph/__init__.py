"""tracegraph: requirement tracing over text corpora as Spark DataFrame plans."""

from .plans.trace import AnalysisResult, TraceResult, analyze, trace  # noqa: F401
from .session import checkpoint_dir, get_session  # noqa: F401

__version__ = "0.1.0"
