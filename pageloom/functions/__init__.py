"""Column expressions: text, HTML, URLs, hosts, character sets and retry delays."""
