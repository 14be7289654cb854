"""memspark.sources"""
