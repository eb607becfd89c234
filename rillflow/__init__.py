"""rillflow: event pipelines as DataFrame graphs, with a JSON-path expression language and an embedded SQL dialect."""

from .plans.dag import Dag, execute, plan, register
from .plans.flow import Flow
from .plans.sql import run_sql
from .session import session

__all__ = ["Dag", "Flow", "execute", "plan", "register", "run_sql", "session"]
