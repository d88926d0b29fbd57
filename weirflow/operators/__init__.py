from .delivery import DeliveryMode, deduplicated, delivered, record_id
from .eventlog import EventLog
from .pipeline import Pipeline, WindowedPipeline
from .serving import MergeView, ServingView
from .windows import WindowKind, WindowType

__all__ = ["DeliveryMode", "EventLog", "MergeView", "Pipeline", "ServingView", "WindowKind", "WindowType", "WindowedPipeline", "deduplicated", "delivered", "record_id"]
