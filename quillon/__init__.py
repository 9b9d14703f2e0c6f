"""Analytics over text memories and corpora, declared as DataFrame transforms."""
