"""Content extraction over tables of crawled pages, files and threads, as Spark jobs."""
