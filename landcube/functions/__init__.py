"""landcube.functions"""
