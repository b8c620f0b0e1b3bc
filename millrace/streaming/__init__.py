"""The same operators on streams of arriving files."""
