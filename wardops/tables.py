"""A named set of DataFrames, loaded only when asked for."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame

Frame = DataFrame | Callable[[], DataFrame]


class Tables(Mapping[str, DataFrame]):
    """``tables.invoices`` or ``tables["invoices"]``; ``replace`` gives a copy.

    ``id_marks`` holds, for some tables, a frame (last_id) with the highest id ever
    given there, which stays when the row with that id is deleted.
    """

    def __init__(self, frames: Mapping[str, Frame], id_marks: Mapping[str, DataFrame] | None = None):
        self._frames: dict[str, Frame] = dict(frames)
        self.id_marks: dict[str, DataFrame] = dict(id_marks or {})

    def __getitem__(self, name: str) -> DataFrame:
        frame = self._frames[name]
        if not isinstance(frame, DataFrame):
            frame = self._frames[name] = frame()
        return frame

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._frames:
            raise AttributeError(name)
        return self[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._frames)

    def __len__(self) -> int:
        return len(self._frames)

    def replace(self, **frames: Frame) -> "Tables":
        return Tables({**self._frames, **frames}, self.id_marks)

    def marked(self, id_marks: Mapping[str, DataFrame]) -> "Tables":
        """The same tables with more, or newer, id marks."""
        return Tables(self._frames, {**self.id_marks, **id_marks})
