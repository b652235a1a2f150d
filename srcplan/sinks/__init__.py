"""Where results go: JSON, text and markdown. Sinks collect reports, whose size follows what is asked, not the corpus."""
