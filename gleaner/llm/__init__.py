"""Operations of a large text-corpus pipeline. Nothing outside this subpackage imports it."""
