"""Tidy verbs that build Spark DataFrames."""

from .frame import Frame, Verb, tidy
from .functions.convert import *  # noqa: F403
from .functions.convert import ConversionError, locale
from .functions.dates import *  # noqa: F403
from .functions.expr import *  # noqa: F403
from .functions.factors import *  # noqa: F403
from .functions.select import *  # noqa: F403
from .functions.strings import *  # noqa: F403
from .operators.binds import *  # noqa: F403
from .operators.columns import *  # noqa: F403
from .operators.groups import *  # noqa: F403
from .operators.joins import *  # noqa: F403
from .operators.report import *  # noqa: F403
from .operators.reshape import *  # noqa: F403
from .operators.rows import *  # noqa: F403
from .sources.io import *  # noqa: F403

TidyFrame = Frame
