"""Column functions: expressions over text, URLs and packets that stay in the JVM."""
