from .state import (
    AggregatingState, JsonFileStateBackend, KeyedProcessFunction, KeyedState, ListState, MapState, MemoryStateBackend, ProcessFunction, ReducingState, RuntimeContext, StateConfig, TimerService, ValueState,
)
from .viscosity import FlowMetrics, GranularityController, GranularityLevel, GranularityMetrics, GranularityPolicy, Viscosity, ViscosityController, ViscosityPolicy
from .watermarks import LateRouter, Watermark, WatermarkStrategy, WatermarkTracker, late_split

__all__ = [
    "AggregatingState", "FlowMetrics", "GranularityController", "GranularityLevel", "GranularityMetrics", "GranularityPolicy", "JsonFileStateBackend", "KeyedProcessFunction", "KeyedState", "LateRouter", "ListState", "MapState", "MemoryStateBackend", "ProcessFunction",
    "ReducingState", "RuntimeContext", "StateConfig", "TimerService", "ValueState", "Viscosity", "ViscosityController", "ViscosityPolicy", "Watermark", "WatermarkStrategy", "WatermarkTracker", "late_split",
]
