"""Errors that the engine raises."""


class FlowError(Exception):
    """Base of all."""


class PipelineError(FlowError):
    """A pipeline that can't be built or run: no source, no schema, a missing file."""


class SchemaError(FlowError):
    """A record or frame that doesn't fit a declared schema."""


class ConnectorError(FlowError):
    """A source or sink that can't be reached or isn't supported."""


class WatermarkError(FlowError):
    """A watermark on something that has no event time."""


class StateError(FlowError):
    """Keyed state used outside its key or with a value that can't be stored."""


class DeliveryError(FlowError):
    """Records that a delivery guarantee could not be kept for."""
