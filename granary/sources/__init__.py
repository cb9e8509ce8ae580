from granary.sources.delimited import CSV, TBL, DelimitedOptions, load_delimited, load_frame, load_lines

__all__ = ["CSV", "TBL", "DelimitedOptions", "load_delimited", "load_frame", "load_lines"]
